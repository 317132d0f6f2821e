"""License scan: ordered signature rules over word sequences, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words with one space between. Rules are regular
expressions over that form: phrases written by hand, and names with their versions made from families.
Each names a keyword, and a rule runs only on texts that hold its keyword, so most texts run none.
Keywords with a stem in common are looked for only where the stem is. A rule has a priority (1 is the strongest: a grant that names a
license and its version; 4 the weakest: a bare mention). Detections are spans; a span that lies
inside one of the same or a stronger priority is suppressed, so "apache license version 2" does not
also count as "apache license". What survives gives labels, and the best weight is the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import let, lower_ascii, table
from lignum.llm.license_phrases import PHRASES

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
BASE_WEIGHT = 0.9

#: Fixed values: (label, names before the word "license", SPDX id, versions). Written for normalised
#: text, where a point in a version is a space.
FAMILIES = (
    ("mit", ("mit",), "mit", ()),
    ("mit-0", ("mit no attribution",), "mit 0", ()),
    ("x11", ("x11",), "x11", ()),
    ("apache", ("apache", "apache software"), "apache", ("1", "1 1", "2")),
    ("gpl", ("general public", "gpl"), "gpl", ("1", "2", "3")),
    ("lgpl", ("lesser general public", "library general public", "lgpl"), "lgpl", ("2", "2 1", "3")),
    ("agpl", ("affero general public", "agpl"), "agpl", ("1", "3")),
    ("gfdl", ("free documentation",), "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public",), "mpl", ("1", "1 1", "2")),
    ("epl", ("eclipse public",), "epl", ("1", "2")),
    ("edl", ("eclipse distribution",), "edl", ("1",)),
    ("cddl", ("common development and distribution",), "cddl", ("1", "1 1")),
    ("cpl", ("common public",), "cpl", ("1",)),
    ("ipl", ("ibm public",), "ipl", ("1",)),
    ("apsl", ("apple public source",), "apsl", ("1", "1 1", "1 2", "2")),
    ("artistic", ("artistic",), "artistic", ("1", "2")),
    ("afl", ("academic free",), "afl", ("1 1", "1 2", "2", "2 1", "3")),
    ("osl", ("open software",), "osl", ("1", "1 1", "2", "2 1", "3")),
    ("eupl", ("european union public",), "eupl", ("1", "1 1", "1 2")),
    ("cecill", ("cecill",), "cecill", ("1", "1 1", "2", "2 1")),
    ("bsl", ("boost software",), "bsl", ("1",)),
    ("busl", ("business source",), "busl", ("1 1",)),
    ("sspl", ("server side public",), "sspl", ("1",)),
    ("elastic", ("elastic",), "elastic", ("2",)),
    ("zlib", ("zlib",), "zlib", ()),
    ("libpng", ("libpng",), "libpng", ("2",)),
    ("isc", ("isc",), "isc", ()),
    ("ncsa", ("ncsa", "ncsa open source"), "ncsa", ()),
    ("postgresql", ("postgresql",), "postgresql", ()),
    ("php", ("php",), "php", ("3", "3 01")),
    ("python", ("python", "python software foundation", "psf"), "psf", ("2",)),
    ("ruby", ("ruby",), "ruby", ()),
    ("openssl", ("openssl",), "openssl", ()),
    ("wtfpl", ("wtfpl", "what the fuck you want to public"), "wtfpl", ("1", "2")),
    ("ofl", ("open font",), "ofl", ("1", "1 1")),
    ("lppl", ("latex project public",), "lppl", ("1", "1 1", "1 2", "1 3")),
    ("w3c", ("w3c", "w3c software"), "w3c", ()),
    ("zpl", ("zope public",), "zpl", ("1 1", "2", "2 1")),
    ("upl", ("universal permissive",), "upl", ("1",)),
    ("mulan", ("mulan psl", "mulan permissive software"), "mulanpsl", ("1", "2")),
    ("ms-pl", ("microsoft public",), "ms pl", ()),
    ("ms-rl", ("microsoft reciprocal",), "ms rl", ()),
    ("odbl", ("open database", "open data commons open database"), "odbl", ("1",)),
    ("odc-by", ("open data commons attribution",), "odc by", ("1",)),
    ("openrail", ("openrail", "openrail m"), "openrail", ()),
)
#: Creative Commons kinds (label, words, SPDX id) and versions.
CC_KINDS = (
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by-nd", "attribution no ?deriv(?:ative|ative work)?s", "by nd"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|ative work)?s", "by nc nd"),
)
CC_VERSIONS = ("1", "2", "2 5", "3", "4")
#: Parts of keywords that are looked for first: a keyword with one of them is looked for only in texts that hold it.
STEMS = ("licen", "spdx", "creative", "copyright", "permi", "warrant", "redistribut", "public", "proprietary", "granted", "software", "source", "exception", "gpl", "bsd", "apache", "font", "commercial", "reserved", "purposes", "documentation", "hereby", "law", "cc by", "contributor")
#: Places of a rule in one text that are appended to one array.
BLOCK = 256
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
STRONGEST, WEAKEST = 1, 4


def _zeros(version: str) -> str:
    """A version as written: "2" may also be "2 0", and "v2" is "version 2"."""
    return version + ("" if " " in version else "(?: 0)?")


def rules() -> list[tuple[int, str, str, str]]:
    """All rules in order: (priority, label, keyword, pattern). A keyword occurs in all that its pattern matches."""
    found = [(p, label, keyword, pattern) for label, pattern, keyword, p in PHRASES]
    later = "(?: or (?:any )?later(?: version)?| only)?"
    grant = "(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?"
    for label, names, spdx, versions in FAMILIES:
        tag = f"spdx license identifier {spdx}"
        for v in versions:
            named = f"{label}-{v.replace(' ', '.')}"
            found.append((3, named, tag, f"{tag} {_zeros(v)}{later}"))
            for name in names:
                numbered = f"{name} licen[cs]e(?: agreement)? (?:version |v ?)?{_zeros(v)}{later}"
                found.append((1, named, f"{name} licen", grant + numbered))
                found.append((2, named, f"{name} licen", "(?:gnu )?" + numbered))
        found.append((3, label, tag, tag))
        for name in names:
            found.append((3, label, f"{name} licen", f"{grant}{name} licen[cs]e"))
            found.append((4, label, f"{name} licen", f"(?:gnu )?{name} licen[cs]e"))
    for label, words, spdx in CC_KINDS:
        for v in CC_VERSIONS:
            named = f"{label}-{v.replace(' ', '.')}"
            found.append((2, named, "creative commons", f"creative commons {words} {_zeros(v)}(?: (?:international|unported|generic))?"))
            found.append((2, named, f"cc {spdx}", f"cc {spdx} {_zeros(v)}"))
        found.append((3, label, "creative commons", f"creative commons {words}"))
        found.append((3, label, f"cc {spdx}", f"cc {spdx}"))
        found.append((3, label, f"licenses {spdx}", f"creativecommons org licenses {spdx}"))
    found += [(2, label, phrase, phrase) for phrase, label in BASE]
    return sorted(found, key=lambda r: r[0])


def _by_stem(keywords: list[str]) -> dict[str, list[str]]:
    """Keywords by the first stem in them; those without are their own."""
    found: dict[str, list[str]] = {}
    for k in keywords:
        found.setdefault(next((s for s in STEMS if s in k), k), []).append(k)
    return found


def _texts(values: list[str]) -> str:
    """SQL literals. Patterns, keywords and labels hold neither quotes nor backslashes."""
    return ", ".join(f"'{v}'" for v in values)


def _present(keywords: list[str]) -> Column:
    """The keywords that ``t`` holds. As SQL text, since some hundred expressions made one by one take the driver seconds."""
    gates = []
    for stem, own in _by_stem(keywords).items():
        rest = [k for k in own if k != stem]
        if stem in own:
            gates.append(f"IF(contains(t, '{stem}'), array('{stem}'), NULL)")
        if rest:
            gates.append(f"IF(contains(t, '{stem}'), filter(array({_texts(rest)}), k -> contains(t, k)), NULL)")
    return F.expr(f"flatten(array_compact(array({', '.join(gates)})))")


def _by_keyword(found: list[tuple[int, str, str, str]]) -> Column:
    """The rules of each keyword, as a map of arrays."""
    parts: dict[str, list[str]] = {}
    for order, (priority, label, k, rx) in enumerate(found):
        parts.setdefault(k, []).append(f"named_struct('priority', {priority}, 'label', '{label}', 'order', {order}, 'pattern', '(?<= ){rx}(?= )')")
    return F.expr("map(" + ", ".join(f"'{k}', array({', '.join(own)})" for k, own in parts.items()) + ")")


def _spans(t: Column, rule: Column) -> Column:
    """All places of a rule: (start, minus end, priority, order, label)."""
    hits = F.regexp_extract_all(t, rule["pattern"], F.lit(0))

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(t, rule["pattern"], -1), lambda x: F.length(x))
        sizes = F.transform(hits, lambda x: F.length(x))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size")))

        def ends(pairs: Column) -> Column:
            """(start, minus end) of each pair in turn, from the start. Appending copies what is there, so few are appended to one array."""
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
            none = F.array().cast("array<struct<start:int,least:int>>")

            def step(acc: Column, x: Column) -> Column:
                at = acc["at"] + x["gap"]
                return F.struct((at + x["size"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(at.alias("start"), (-(at + x["size"])).alias("least")))).alias("spans"))

            def begun(acc: Column, block: Column) -> Column:
                length = F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
                return F.struct((acc["at"] + length).alias("at"), F.concat(acc["from"], F.array(acc["at"])).alias("from"))

            starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from")), begun)["from"]
            parts = F.zip_with(blocks, starts, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step)["spans"])
            return F.flatten(parts)

        return F.transform(
            let(pairs, ends),
            lambda s: F.struct(s["start"].alias("start"), s["least"].alias("least"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label")),
        )

    return let(hits, lambda h: F.when(F.size(h) > 0, placed(h)))


def _survivors(spans: Column) -> Column:
    """Labels and best weight of spans that no other of the same or a stronger priority contains.

    In order of start, longest first, a span is contained if a span before it ends at or beyond its
    end, so one pass that keeps the furthest end of each priority is enough.
    """
    levels = range(STRONGEST, WEAKEST + 1)
    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    weight = {p: F.lit(WEIGHTS[p]) for p in levels}

    def step(acc: Column, x: Column) -> Column:
        end = -x["least"]
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((x["priority"] >= p) & (acc[f"end{p}"] >= end))
        own = F.coalesce(*[F.when(x["priority"] == p, w) for p, w in weight.items()])
        return F.struct(
            *[F.when(x["priority"] == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels],
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], own)).alias("score"),
        )

    return F.aggregate(F.array_sort(spans), start, step)


def scan(docs: DataFrame) -> DataFrame:
    """Licenses named in each whole text.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns one row for each input
    row: ``doc_id, n_words, n_base`` (places of base phrases), ``first_word, last_word`` (smallest
    and largest start of those, in words from 0, else null), ``base_labels, labels`` (distinct,
    sorted, joined by commas; empty if none) and ``score`` (0 if nothing was found).

    Null or empty text has no words and no labels. Repeated rows each give a row; an empty table gives
    none. A text may hold a phrase any number of times; its places are summed up in blocks of ``BLOCK``.
    """
    table_of = rules()
    keywords = sorted({r[2] for r in table_of})
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    words = docs.select("doc_id", F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce("text", F.lit(""))), F.lit(" ")), NOT_WORD, " ").alias("t"))
    t = F.col("t")
    n = spaces(t) - 1

    def places(phrase: str, label: str) -> Column:
        parts = F.split(t, f"(?<= ){phrase}(?= )", -1)
        found = let(
            parts,
            lambda p: F.struct(
                (F.size(p) - 1).alias("n"),
                (spaces(F.get(p, F.lit(0))) - 1).alias("first"),
                (n - spaces(F.element_at(p, -1)) + 1 - len(phrase.split())).alias("last"),
                F.lit(label).alias("label"),
            ),
        )
        return F.when(t.contains(f" {phrase} "), found)

    base = F.array_compact(F.array(*[places(*b) for b in BASE]))
    df = words.select("doc_id", t, n.cast("long").alias("n_words"), base.alias("base"), _present(keywords).alias("present"))

    as_rules = _by_keyword(table_of)
    live = F.flatten(F.transform("present", lambda k: F.element_at(as_rules, k)))
    spans = F.flatten(F.array_compact(F.transform(live, lambda r: _spans(t, r))))
    df = df.withColumn("found", F.when(F.size("present") > 0, _survivors(spans)))
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return df.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0), lambda a, b: a + b["n"]).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.coalesce(F.col("found")["labels"], F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce(F.col("found")["score"], F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with all rules."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLE_SQL: dict[str, str] = {}
