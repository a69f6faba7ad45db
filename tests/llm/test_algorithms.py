"""Similar vectors, rank aggregation, near duplicates: brute force, guarantees and edge cases."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import buckets, near, ranking, vectors

NODES = "id string, label string, summary string, embedding array<float>, class string, rep string, vec int, doc int"


def node(i, label="", summary="", vec=None):
    return (i, label, summary, vec, "c", None, 1, None)


def brute_neighbours(rows, k=10, least=0.97):
    live = {i: np.array(v, float) for i, _, _, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = set()
    for i, v in live.items():
        cos = sorted(((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in live.items() if j != i and len(w) == len(v)))[:k]
        out |= {tuple(sorted((i, j))) for c, j in cos if -c >= least - 1e-9}
    return out


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 32))
    rows = [node(f"n{i:03}", vec=[float(x) for x in v]) for i, v in enumerate(np.vstack([base, base[:30] + 0.05 * rng.standard_normal((30, 32)), base[:5] * 7]))]
    rows += [node("short", vec=[1.0, 0.0]), node("short2", vec=[2.0, 0.01]), node("zero", vec=[0.0] * 32), node("none"), node("nan", vec=[float("nan")] * 32), node("hole", vec=[None] * 32), node("empty", vec=[]), node(None, vec=[1.0] * 32)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, NODES)
    assert {tuple(r) for r in vectors.similar_pairs(df).collect()} == brute_neighbours(rows)


def test_many_copies_answer_with_their_first_ids(spark):
    rows = [node(f"c{i:03}", vec=[1.0, 2.0, 3.0, 4.0]) for i in range(200)] + [node("x", vec=[4.0, -1.0, 0.0, 1.0])]
    got = {tuple(r) for r in vectors.similar_pairs(spark.createDataFrame(rows, NODES)).collect()}
    assert got == brute_neighbours(rows)
    places = vectors.nearest(spark.createDataFrame(rows, NODES)).where("id = 'c005'").orderBy("place").collect()
    assert [r.other for r in places] == [f"c{i:03}" for i in range(11) if i != 5] and [r.place for r in places] == list(range(1, 11))


@pytest.mark.parametrize(("block", "stream"), [(8192, 1 << 20), (40, 70)])
def test_every_id_has_its_ten_nearest_however_far(spark, monkeypatch, block, stream):
    monkeypatch.setattr(vectors, "BLOCK", block, raising=False)
    monkeypatch.setattr(vectors, "STREAM", stream, raising=False)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((150, 16)).astype(np.float32)
    vecs = [*base, *base[:20], *2 * base[:20], *np.eye(16)[rng.integers(0, 16, 40)], *-np.eye(16), *rng.standard_normal((12, 3)), *rng.standard_normal((30, 1)), *rng.standard_normal((4, 5))]
    rows = [node(f"n{i:03}", vec=[float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(vecs)), vecs)]
    live = {r[0]: np.array(r[3], np.float32).astype(float) for r in rows}
    want = set()
    for i, v in live.items():
        near = sorted((-round(float(v @ w / math.sqrt((v @ v) * (w @ w))), 12), j) for j, w in live.items() if j != i and len(w) == len(v))
        want |= {(i, j, place + 1) for place, (_, j) in enumerate(near[:10])}
    rows += rows[:9] + [node("zero", vec=[0.0] * 16), node("none"), node("hole", vec=[None] * 16), node(None, vec=[1.0] * 16)]
    got = [(r.id, r.other, r.place) for r in vectors.nearest(spark.createDataFrame(rows, NODES).repartition(3)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_blocks_of_vectors_are_full(spark, monkeypatch):
    """All vectors are streamed past each block, so there should be few, whatever the partitions."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    pack, sizes = vectors.vector_blocks, []

    def spy(classes):
        blocks = pack(classes)
        sizes.extend(len(r.ids) // 8 for r in blocks.select("ids").collect())
        return blocks

    monkeypatch.setattr(vectors, "vector_blocks", spy)
    rows = [node(f"n{i:03}", vec=[float(x) for x in v]) for i, v in enumerate(np.random.default_rng(8).standard_normal((500, 4)))]
    name, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(name, "false")
    try:
        assert vectors.nearest(spark.createDataFrame(rows, NODES)).count() == 5000
    finally:
        spark.conf.set(name, before)
    assert sorted(sizes) == [20] + [40] * 12


def test_few_cosines_are_computed_again(monkeypatch):
    """Of a stream of 16,000 vectors, each of a block looks at few more than its ten best so far, exactly."""
    rng = np.random.default_rng(2)
    vecs, ids = rng.standard_normal((16_000, 16)).astype(np.float32), np.arange(16_000)
    einsum, again = np.einsum, []
    monkeypatch.setattr(np, "einsum", lambda how, *x: again.append(len(x[0])) or einsum(how, *x))
    best = vectors.Best(16, ids[:400], vecs[:400], 10)
    for i in range(0, len(ids), 4000):
        at = slice(i, i + 4000)
        best.meet(ids[at], np.ones(4000, np.int64), pa.array([f"n{j:05}" for j in ids[at]], pa.string()), vecs[at])
    got = best.rows().to_pydict()
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    cos = unit[:400] @ unit.T
    cos[ids[:400], ids[:400]] = -2
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-cos[i])[:10]}
    assert len(got["class"]) == 4000 and set(zip(got["class"], got["other_class"])) == want
    assert all(name == f"n{j:05}" for j, name in zip(got["other_class"], got["other_rep"]))
    assert sum(again) < 50 * 400


@pytest.mark.parametrize("block", [16_384, 60])
def test_crowded_buckets_of_vectors_lose_no_pairs(spark, monkeypatch, block):
    """Where a bucket is crowded, one agreeing substring is still enough."""
    monkeypatch.setattr(buckets, "BLOCK", block, raising=False)
    rng = np.random.default_rng(11)
    vecs = rng.standard_normal(24) + 0.22 * rng.standard_normal((300, 24))
    classes = vectors.vector_classes(spark.createDataFrame([node(f"n{i:03}", vec=[float(x) for x in v]) for i, v in enumerate(vecs)], NODES), "id", "embedding").cache()
    whole, crowded = ({(r.class_a, r.class_b) for r in vectors.similar_classes(classes, vectors.IndexSpec(hot=hot, rounds=0)).collect()} for hot in (10**6, 3))
    assert len(whole) > 500 and crowded == whole


def test_top_k_of_a_query_set_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = {f"n{i:03}": v for i, v in enumerate([*rng.standard_normal((90, 8)), *[np.ones(8)] * 15, *rng.standard_normal((20, 5))])}
    df = spark.createDataFrame([node(i, vec=[float(x) for x in v]) for i, v in vecs.items()], NODES)
    rows = vectors.usable_vectors(df, "id", "embedding").repartition(3)
    mine = [i for n, i in enumerate(vecs) if n % 7 == 0]
    got = {}
    for r in vectors.top_k_blocks(rows, rows.where(rows.id.isin(mine)), 10, block=6).collect():
        got.setdefault(r["query"], []).append((r.place, r.id))
    for q in mine:
        v = vecs[q]
        best = sorted((-round(float(np.dot(v.astype(np.float32), w.astype(np.float32)) / np.linalg.norm(v) / np.linalg.norm(w)), 5), i) for i, w in vecs.items() if i != q and len(w) == len(v))[:10]
        assert [i for _, i in sorted(got[q])] == [i for _, i in best]


def test_no_vectors(spark):
    assert vectors.similar_pairs(spark.createDataFrame([], NODES)).count() == 0
    assert vectors.similar_pairs(spark.createDataFrame([node("a"), node("b", vec=[1.0])], NODES)).count() == 0


def test_rotations_are_orthogonal():
    x = np.random.default_rng(1).standard_normal((200, 12))
    r = vectors.learn_rotations(x, 3, 5, 0)
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(12), atol=1e-4)


def words(label, summary):
    return frozenset(re.findall(r"[^\W_]+", f"{label or ''} {summary or ''}".lower()))


def brute_pairs(rows, least=0.7):
    sets = {r[0]: words(r[1], r[2]) for r in rows if r[0] is not None}
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if x | y and len(x & y) / len(x | y) >= least - 1e-12}


def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(120):
        ws = list(rng.choice(vocabulary, 30))
        rows.append(node(f"a{i:03}", " ".join(ws[:3]), " ".join(ws[3:])))
        if i % 2:
            for k in rng.choice(30, 3):
                ws[k] = f"new{rng.integers(10**6)}"
            rng.shuffle(ws)
            rows.append(node(f"b{i:03}", "", "_".join(ws).upper()))
    return rows


@pytest.mark.parametrize("hot", [256, 3])
def test_near_pairs_equal_brute_force(spark, hot):
    rows = texts() + [node("e1"), node("e2", None, None), node("c1", "Same", "text"), node("c2", "text", "same SAME"), node(None, "same", "text"), node("long", "x " * 200_000, "y"), node("u", "Ünïcode naïve", "日本 語")]
    rows += rows[:5]
    got = {tuple(r) for r in near.near_pairs(spark.createDataFrame(rows, NODES), near.NearSpec(hot=hot)).collect()}
    assert got == brute_pairs(rows)


@pytest.mark.parametrize("block", [16_384, 60])
def test_edited_copies_of_one_text_crowd_buckets_without_loss(spark, monkeypatch, block):
    monkeypatch.setattr(buckets, "BLOCK", block, raising=False)
    rng = np.random.default_rng(12)
    rows = [node(f"n{i:03}", " ".join(f"word{w}" for w in rng.choice(40, 35, replace=False))) for i in range(400)]
    want = brute_pairs(rows)
    assert len(want) > 70_000
    whole, crowded = ({tuple(r) for r in near.near_pairs(spark.createDataFrame(rows, NODES), near.NearSpec(hot=hot)).collect()} for hot in (10**6, 3))
    # The sketch may miss a pair at the threshold itself; crowding may not.
    assert crowded == whole and whole <= want and len(whole) > 0.999 * len(want)


def test_large_class_of_copies_is_linked_to_its_first_id(spark):
    rows = [node(f"k{i:02}", "many copies", "of one text here") for i in range(20)] + [node("z", "many copies", "of one text there")]
    got = {tuple(r) for r in near.near_pairs(spark.createDataFrame(rows, NODES), near.NearSpec(expand=4)).collect()}
    assert got == {("k00", f"k{i:02}") for i in range(1, 20)} | {("k00", "z")}
    groups = {r.id: (r.group_id, r.class_id, r.n_links) for r in near.near_groups(spark.createDataFrame(rows, NODES)).collect()}
    assert groups["z"] == ("k00", "z", 1) and groups["k07"] == ("k00", "k00", 1)


def test_different_texts_of_one_word_set_are_all_paired(spark):
    """Six texts of the same words, one of them in 20 copies: the texts are paired in full, copies go to their first."""
    texts = ["alpha beta gamma", "beta alpha gamma", "Gamma beta alpha", "gamma, alpha beta", "ALPHA beta gamma", "beta gamma alpha"]
    rows = [node(f"t{i}", t) for i, t in enumerate(texts)] + [node(f"u{i:02}", texts[0]) for i in range(20)] + [node("w", "alpha beta gamma delta")]
    df = spark.createDataFrame(rows, NODES)
    firsts = [f"t{i}" for i in range(6)]
    star, other = {("t0", f"u{i:02}") for i in range(20)}, {(t, "w") for t in firsts}
    assert {tuple(r) for r in near.near_pairs(df, near.NearSpec(expand=8)).collect()} == set(itertools.combinations(firsts, 2)) | star | other
    assert {tuple(r) for r in near.near_pairs(df, near.NearSpec(expand=4)).collect()} == {("t0", t) for t in firsts[1:]} | star | {("t0", "w")}
    assert {tuple(r) for r in near.near_pairs(df, near.NearSpec()).collect()} == brute_pairs(rows)


def test_no_texts(spark):
    assert near.near_pairs(spark.createDataFrame([], NODES)).count() == 0
    assert near.near_groups(spark.createDataFrame([node("a")], NODES)).count() == 0


def test_covering_guarantee():
    """Sketches that differ in at most 2 * groups - 1 positions share a key, wherever the differences lie."""
    rng = np.random.default_rng(5)
    groups, width = 6, 5
    a = rng.integers(0, 2**32, (300, groups * width), dtype=np.uint32)
    b = a.copy()
    for row in b:
        at = rng.choice(groups * width, 2 * groups - 1, replace=False)
        row[at] += np.uint32(1)
    hit = np.zeros(300, bool)
    for (_, x), (_, y) in zip(near.covering_keys(a, groups, width), near.covering_keys(b, groups, width)):
        hit |= x == y
    assert hit.all()


def test_pair_runs_gives_all_pairs_of_a_run():
    key = np.array([1, 1, 1, 2, 3, 3])
    doc = np.array([5, 4, 9, 1, 7, 7])
    everything = [np.zeros(6, np.int64)] * 3
    got = {(int(x), int(y)) for a, b in buckets.pair_runs(doc, key, everything, lambda p, q: np.ones(len(p[0]), bool)) for x, y in zip(a, b)}
    assert got == {(4, 5), (5, 9), (4, 9)}


SCORED = "query_id long, node_id string, sim_score double, bm25_score double, frequency_score double, recency_score double, n int, place string, q string"


def scored_rows(seed, n_queries=6, n=25):
    rng = np.random.default_rng(seed)
    pool = [None, float("nan"), 0.0, 1.0, 1e300, float("-inf"), float("inf")]
    rows = []
    for q in range(n_queries):
        for i in range(n):
            s = [float(rng.standard_normal()) if rng.random() < 0.8 else pool[rng.integers(len(pool))] for _ in range(4)]
            rows.append((q, f"n{i}", *s, 1, "x", None))
        if q % 2:
            rows.append((q, "top", 1e301, 1e301, 1e301, None, 1, None, None))
    rows += [(None, "only", 1.0, None, None, None, 1, None, None), (99, "lone", None, None, None, None, 1, None, None), (98, "a", 1.0, 1.0, 1.0, 1.0, 1, None, None), (98, "b", 1.0, 1.0, 1.0, 1.0, 1, None, None)]
    return rows + rows[:7]


def brute_dominant(rows):
    per = {}
    for q, i, *s in rows:
        per.setdefault(q, {})[i] = [None if x is None or np.isnan(x) else x for x in s[:4]]
    beats = lambda x, y: sum(a is not None and (b is None or a > b) for a, b in zip(x, y)) >= 3
    return {(q, i) for q, c in per.items() for i, x in c.items() if all(beats(x, y) for j, y in c.items() if j != i)}


@pytest.mark.parametrize("spec", [ranking.RankSpec(), ranking.RankSpec(rows=20, share=0.001, pieces=5)])
def test_dominant_equals_brute_force(spark, spec):
    rows = scored_rows(1)
    got = {tuple(r) for r in ranking.dominant(spark.createDataFrame(rows, SCORED), spec=spec).collect()}
    assert got == brute_dominant(rows)


def test_heavy_and_ordinary_paths_rank_alike(spark):
    df = spark.createDataFrame(scored_rows(2), SCORED)
    plain = {(r.query_id, r.node_id): (r.rho, r.mean_rank, r.place) for r in ranking.aggregate_ranks(df).collect()}
    heavy = {(r.query_id, r.node_id): (r.rho, r.mean_rank, r.place) for r in ranking.aggregate_ranks(df, ranking.RankSpec(rows=20, share=0.001, pieces=7)).collect()}
    assert plain == heavy and len(plain) == len({(r[0], r[1]) for r in scored_rows(2)})


def test_no_score_rules_by_its_range(spark):
    rows = [(1, f"n{i}", i / 10, 1e9 * (i == 0), float(i), i / 100, 1, None, None) for i in range(10)]
    ranked = ranking.aggregate_ranks(spark.createDataFrame(rows, SCORED)).orderBy("place").collect()
    assert ranked[0].node_id == "n9"
    assert ranking.aggregate_ranks(spark.createDataFrame([], SCORED)).count() == 0
    assert ranking.dominant(spark.createDataFrame([], SCORED)).count() == 0


@pytest.mark.parametrize("chunk,hot", [(10**9, None), (40, None), (40, 8), (7, 8), (1, 3)])
def test_runs_that_cross_batches_lose_nothing(monkeypatch, chunk, hot):
    """Pairs of small runs and rows of crowded ones come out whole, however the rows are cut into batches."""
    import pyarrow as pa

    monkeypatch.setattr(buckets, "CHUNK", chunk)
    rng = np.random.default_rng(chunk % 97 + (hot or 0))
    sizes = rng.choice([1, 2, 3, 5, 9, 30, 120], 60)
    key = np.repeat(np.sort(rng.choice(10**6, 60, replace=False)), sizes).astype(np.int64)
    doc = rng.permutation(len(key)).astype(np.int64)
    cols = [doc, np.zeros(len(key), np.int32), key, np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)]
    cuts = np.r_[0, np.sort(rng.choice(len(key), 25, replace=False)), len(key)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], names=list("abcdef")) for a, b in zip(cuts, cuts[1:]) if b > a]
    pairs, crowded = [], []
    for b in buckets._runs(batches, lambda x, y: np.ones(len(x[0]), bool), hot):
        for r in b.to_pylist():
            (pairs if r["b"] is not None else crowded).append((r["a"], r["b"]) if r["b"] is not None else (r["key"], r["a"]))
    want_pairs, want_crowded = set(), set()
    for k in np.unique(key):
        members = sorted(doc[key == k].tolist())
        if hot and len(members) > hot:
            want_crowded |= {(int(k), d) for d in members}
        else:
            want_pairs |= set(itertools.combinations(members, 2))
    assert sorted(pairs) == sorted(want_pairs) and sorted(crowded) == sorted(want_crowded)


@pytest.mark.parametrize("hot", [3, 256, 1000])
@pytest.mark.parametrize("known", [False, True])
def test_one_shared_crowded_bucket_gives_all_pairs(spark, monkeypatch, hot, known):
    """300 documents that share one key and nothing else: every pair comes out, salted beforehand or found crowded."""
    monkeypatch.setattr(buckets, "BLOCK", 50)
    import pyarrow as pa

    n = 300
    doc = np.arange(n, dtype=np.int64)
    crowded = np.array([7], np.int64) if known else np.zeros(0, np.int64)
    parts = [(doc, np.full(n, 7, np.int64), 0), (doc, doc + 1000, 1)]
    rows = [(int(d), int(p), int(k), 0, 0, 1) for ds, ks, part in parts for d, p, k in zip(ds, buckets.salted_parts(ds, ks, part, crowded), ks)]
    keys = spark.createDataFrame(rows, "doc long, part int, key long, sig long, sig2 long, size int").repartition(4)
    everything = lambda a, b: np.ones(np.broadcast_shapes(a[0].shape, b[0].shape), bool)
    assert buckets.candidate_pairs(keys, everything, hot).count() == n * (n - 1) // 2 and pa.__version__
    assert buckets.crowded_keys(keys, 1.0, 256).tolist() == [7]
    assert len({buckets.salted_parts(doc, np.full(n, 7, np.int64), 0, np.array([7]))[i] for i in range(n)}) > 30


def test_group_numbers_keep_the_chance_of_a_miss():
    spec = near.NearSpec()
    small = (1 - near.hit(spec.width(1000), near.AGREE)) ** spec.parts(1000)
    for n in (10**6, 10**7, 10**8, 10**10, 10**12):
        assert (1 - near.hit(spec.width(n), near.AGREE)) ** spec.parts(n) <= small + 1e-12
    rng = np.random.default_rng(0)
    same = rng.random((200_000, 6)) < near.AGREE
    met = np.any([same[:, [i for i in range(6) if i % 3 != v]].all(axis=1) for v in range(3)], axis=0)
    assert abs(met.mean() - near.hit(6, near.AGREE)) < 0.005


def test_unconnected_after_all_rounds_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "class_a long, class_b long")
    nodes = spark.createDataFrame([(i,) for i in range(65)], "class long")
    assert near.connected_groups(chain, nodes).select("group").distinct().count() == 1
    with pytest.raises(RuntimeError):
        near.connected_groups(chain, nodes, rounds=1)


@pytest.mark.parametrize("n", [2, 3, 10, 64, 500])
def test_no_winner_has_a_rho_beyond_the_bound(n):
    """Random winners: the others' positions are as good as a loss in all but one score allows."""
    rng = np.random.default_rng(n)
    bound = ranking.rank_bound(n, 4, 3)
    assert bound <= ranking.rank_bound(n - 1, 4, 3) + 1e-9
    for _ in range(300):
        share = rng.dirichlet(rng.choice([0.2, 1, 20]) * np.ones(4))
        ahead = rng.multinomial(n - 1, share)
        r = np.sort((ahead + 1) / n)
        t = min(sum(math.comb(4, j) * r[k - 1] ** j * (1 - r[k - 1]) ** (4 - j) for j in range(k, 5)) for k in range(1, 5))
        assert min(1.0, 4 * t) <= bound + 1e-9
