import numpy as np
import pytest

from lignum.llm import ann, near_vectors
from lignum.llm.vectors import hadamard, rotated, signs

DDL = "vec_id long, embedding array<float>, label int, kept string"


def data(n=500, d=20, seed=0):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(40, d))
    x = base[draw.integers(0, 40, n)] + draw.normal(size=(n, d)) * draw.choice([0.02, 0.08, 0.1, 0.5], size=(n, 1))
    rows = [(int(i), [float(v) for v in r], int(i) % 3, "x") for i, r in enumerate(x.astype(np.float32))]
    rows += [(1000 + i, rows[7][1], rows[7][2], "x") for i in range(5)] + [(2000 + i, [v * 3 for v in rows[8][1]], rows[8][2], "x") for i in range(3)]
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0] * (d + 1), [1.0] * (d + 1)]
    rows += [(3000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(4000, rows[7][1], None, "x"), (None, rows[7][1], rows[7][2], "x"), rows[7]]
    return rows


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize(("tile", "bucket"), [(8, 256), (512, 256), (512, 4), (8, 4)])
def test_near_duplicates(spark, monkeypatch, tile, bucket):
    """With no hash, since the labels are small, and with several."""
    monkeypatch.setattr(near_vectors, "BUCKET", bucket)
    rows = data()
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, DDL), tile=tile).collect()
    assert len(got) == len(rows)
    usable = [r for r in rows if sound(r[1]) and r[2] is not None and r[0] is not None]
    links, root = {}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, a in enumerate(usable):
        for b in usable[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    pairs += 1
                    for r in (a, b):
                        links[r[0]] = links.get(r[0], 0) + 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    links[7] -= links[7] // 2  # its row is there twice, and both count
    found = sum(r.n_links for r in got) / 2
    assert pairs * 0.995 <= found <= pairs
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and not r.kept and r.n_links == 0
        else:
            assert r.component_id == find(r.vec_id) and r.kept == (r.vec_id == r.component_id)
    assert near_vectors.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(4)
    a = draw.normal(size=64)
    b = 0.8 * a + 0.6 * draw.normal(size=64)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    found = []
    for seed in range(600):
        flips = signs(1, 128, seed)[0]
        estimate, error = near_vectors.estimates(near_vectors.code_of(a[None], flips, seed), near_vectors.code_of(b[None], flips, seed), 128)
        found.append(estimate[0, 0])
        assert abs(estimate[0, 0] - a @ b) <= error[0, 0]
    assert abs(np.mean(found) - a @ b) < 4 * np.std(found) / np.sqrt(len(found))


def test_codes_give_the_product_they_stand_for():
    x = np.random.default_rng(2).normal(size=(6, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    flips = signs(1, 32, 3)[0]
    code = near_vectors.code_of(x, flips)
    estimate, _ = near_vectors.estimates(code, code, 32)
    y = rotated(near_vectors.padded(x, 32), flips)
    planes = [np.unpackbits(code["planes"][:, j].copy().view(np.uint8), axis=1, bitorder="little")[:, :32] for j in range(4)]
    fine = code["low"][:, None] + code["step"][:, None] * sum(p.astype(float) * 2**j for j, p in enumerate(planes))
    assert np.allclose(estimate, np.where(y >= 0, 1, -1) @ fine.T / np.sqrt(32) / code["factor"][:, None])
    assert np.abs(fine - y).max() <= code["step"].max() + 1e-9


def test_the_chance_to_miss_a_pair_is_bounded():
    for rows in (100, 10**4, 10**6, 10**9):
        widths = near_vectors.polytopes(rows, 64)
        chance = np.prod([near_vectors.shared(w, 0.98) for w in widths]) if widths else 1
        assert (1 - chance) ** near_vectors.rotations(widths, 0.98) <= near_vectors.MISS
        assert rows / np.prod([2 * w for w in widths]) < 1024


def test_all_pairs_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x, label, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.label for r in rows]), np.array([r.vec_id for r in rows])
    linked = (x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(df).collect()}
    assert got == dict(zip(ids.tolist(), linked.sum(axis=1).tolist(), strict=True))


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(hadamard(hadamard(x)), x)
    y = rotated(x, signs(1, 32, 3)[0])
    assert np.allclose(y @ y.T, x @ x.T)


def brute(rows, top=20, width=20):
    good = [r for r in rows if sound(r[1]) and r[0] is not None and len(r[1]) == width]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], dtype=np.float32).astype(np.float64)
    ids, at = np.unique(ids, return_index=True)
    x = x[at]
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score.round(12))) if j != i][:top]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_search(spark, monkeypatch, block):
    """Through cells, with one hash and with several; vectors of another length are a space of their own."""
    monkeypatch.setattr(ann, "CELL_ROWS", 2 if block == 16 else 256)
    rows = data()
    df = spark.createDataFrame(rows, DDL)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), block=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows) | {q: best for q, best in brute(rows, width=21).items() if best}
    assert set(got) == set(want)
    hit = 0
    for q, best in want.items():
        mine = [got[q][k] for k in range(1, len(got[q]) + 1)]
        assert len(mine) <= 20 and mine == sorted(mine, key=lambda x: (-x[1], x[0])) and len({i for i, _ in mine}) == len(mine)
        hit += len({i for i, _ in mine} & {i for i, _ in best})
        exact = dict(best)
        assert all(abs(s - exact[i]) < 1e-9 for i, s in mine if i in exact)
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_search_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (20, [-1.0, 0.5], 1, "x")], DDL)
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(few, few.filter("vec_id % 20 = 0")).collect()}
    assert got[(0, 1)] == 1 and got[(20, 1)] in (0, 1)
    none = spark.createDataFrame([(0, None, 1, "x")], DDL)
    assert ann.search(none, none).count() == 0 and ann.search(none.limit(0), none).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in df.collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = {int(v) for v in ids[np.argsort(-score)[:20]]}
        hit, total = hit + len(best & got[int(ids[i])]), total + 20
    assert hit >= 0.9 * total


@pytest.mark.parametrize("n", [5, 15])
def test_search_returns_all_of_few(spark, n):
    draw = np.random.default_rng(3)
    rows = [(i, [float(v) for v in x], 1, "x") for i, x in enumerate(draw.normal(size=(n, 20)).astype(np.float32))]
    df = spark.createDataFrame(rows, DDL)
    for made in (df, df.union(df.crossJoin(spark.range(40)).select(*df.columns))):  # repeated rows are one candidate
        got = ann.search(made, df.filter("vec_id < 3")).collect()
        assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in range(3) for k in range(1, n)]
        assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q in range(3) for i in range(n) if i != q}


@pytest.mark.parametrize("scale", [1, 5, 1000])
def test_search_with_one_long_vector(spark, scale):
    """Enough rows of length 1 for cells, and one that may be longer: at production parameters, on the hardest data, without any structure."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[777] *= scale
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)], DDL)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, hit = x.astype(np.float64), 0
    for i in range(0, 5000, 20):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argsort(-score)[:20].tolist()
        assert len(got[i]) == 20 and (scale == 1 or (777 in got[i]) == (777 in best))
        hit += len(set(best) & set(got[i]))
    print("recall", hit / 250 / 20)
    assert hit >= 0.9 * 250 * 20


@pytest.mark.parametrize("d", [1, 2, 3])
def test_search_in_few_dimensions(spark, d):
    """Fewer axes than probes."""
    x = np.random.default_rng(d).normal(size=(300, d)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)], DDL)
    got = {}
    for r in ann.search(df, df.filter("vec_id < 40")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, hit = x.astype(np.float64), 0
    for i in range(40):
        score = x @ x[i]
        score[i] = -np.inf
        hit += len(set(np.argsort(-score, kind="stable")[:20].tolist()) & set(got[i]))
        assert len(got[i]) == 20
    assert hit >= 0.9 * 40 * 20


def test_cells_are_made_for_the_number_of_rows():
    for rows in (100, 50_000, 10**6, 10**8, 10**10):
        widths = ann.polytopes(rows, 128)
        cells = int(np.prod([2 * w for w in widths]))
        assert len(widths) == 1 or 256 <= rows / cells < 1024
        assert ann.probe_count(widths) <= cells
