import hashlib
import io
import random

import zstandard
from pyarrow import fs

from lignum.llm import warc
from lignum.llm.common import scratch


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS record_type")


def pages():
    draw = random.Random(2)
    words = ["<p>", "</p>", "été", "the", "of", "word", "<div class='x'>", "\r\n\r\n", "\n"]
    rows = [(i, f"http://e.org/{i}", " ".join(draw.choice(words) for _ in range(draw.randint(1, 400)))) for i in range(150)]
    long = "ab é" * 400
    rows += [(1000 + i, "http://e.org/dup x", long) for i in range(20)] + [(2000, None, None), (2001, "u", ""), (2002, "u", "short"), (2003, "u", "short"), (None, "u", long), (None, None, None)]
    return rows + [rows[-7], (1019, "again", long), (3000, "u", "x" * 3_000_000), (3001, "u", "e" * 999), (3002, "u", "e" * 999)]


def test_round_trip(spark):
    rows = pages()
    got = warc.archive(make(spark, rows)).collect()
    latest = {}
    for i, _, html in rows:
        if i is not None:
            latest[html or ""] = max(i, latest.get(html or "", i))
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        top = latest.get(html or "")
        again = len(data) >= 1000 and sum((h or "") == (html or "") for _, _, h in rows) > 1 and i != top
        url = url and url.replace(" ", "%20")
        want.append((i, url, None if again else html or "", len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_archives_start_with_the_dictionary(spark):
    df = make(spark, pages())
    path, words = scratch(spark, "warc-test"), warc.build_dictionary(df)
    assert words
    manifest = warc.write(warc.with_types(df), path, words).collect()
    store, folder = fs.FileSystem.from_uri(path)
    assert sum(r.records for r in manifest) == df.count()
    for r in manifest:
        data = store.open_input_stream(f"{folder}/{r.file}").read()
        assert data[:4] == bytes.fromhex("5D2A4D18") and data[8 : 8 + len(words)] == words
        assert len(list(warc.frames(io.BytesIO(data), 7 if len(data) < 50_000 else 4096))) == r.records
        # The first record alone, by the library.
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)).decompressobj()
        assert one.decompress(data[8 + len(words) :]).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    assert warc.archive(make(spark, [])).count() == 0


def test_few_records_need_no_dictionary(spark):
    assert warc.archive(make(spark, [(1, "u", "a"), (2, None, None)])).count() == 2


def test_dictionary_of_long_or_few_pages(spark):
    """Pages that are all long, or too few to train on, still give a dictionary, and archives that it opens."""
    draw = random.Random(9)
    long = [(i, "u", " ".join(draw.choice(["<p>", "the", "été", "</p>", "of", str(draw.randrange(999))]) for _ in range(20_000))) for i in range(40)]
    for rows in (long, long[:1], [(1, "u", "short"), (2, None, None)]):
        assert all(len(h or "") > warc.SAMPLE_CHARS for _, _, h in rows) or len(rows) == 2
        df = make(spark, rows)
        words = warc.build_dictionary(df)
        assert 0 < len(words) <= warc.DICTIONARY_BYTES
        path = scratch(spark, "warc-long")
        got = warc.read(warc.write(warc.with_types(df), path, words), path).collect()
        assert {(r.page_id, r.payload_digest) for r in got} == {(i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    assert warc.build_dictionary(make(spark, [(1, "u", None), (2, "u", "")])) == b""
