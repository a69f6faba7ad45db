"""Leakage, mixing and language identification: brute force, held-out accuracy and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langid, leakage, mixing
from loomgraph.llm.words import hash_words, words

DOCS = "doc_id long, text string, lang string, source string, label string, tokens int, share string"
ITEMS = "item_id long, text string, suite string, lang string"


def doc(i, text, lang=None, source=None):
    return (i, text, lang, source, "l", 1, "s")


def brute_leaks(docs, items, run=12):
    grams = {}
    for i, t, *_ in items:
        w = words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_leaks_equal_brute_force(spark):
    items = [(1, ITEM, "s", "en"), (2, ITEM, "s", "en"), (3, "too short", None, None), (4, None, None, None), (5, "", None, None), (6, "a b " * 20, None, None), (None, ITEM, None, None)]
    ws = ITEM.split()
    docs = [
        doc(1, "x " + ITEM.upper() + " y"), doc(2, "＿".join(ws[2:14])), doc(3, " ".join(ws[:11])), doc(4, " ".join([*ws[:6], "other", *ws[7:]])), doc(5, None), doc(6, ""), doc(7, "​".join(ws)),
        doc(8, "b a " * 9), doc(9, "ab " * 300_000 + ITEM), doc(10, ", ".join(w[0] + "­" + w[1:] for w in ws)), doc(None, ITEM), doc(1, "x " + ITEM.upper() + " y"),
    ]
    got = {tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute_leaks([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None])
    assert (1, 1) in got and (1, 2) in got and (2, 1) in got and (10, 1) in got and (9, 1) in got and (3, 1) not in got and (4, 1) not in got


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_either_join_of_hashes_gives_the_same(spark, data, broadcast):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        whole = {tuple(r) for r in leakage.leaks(docs, items).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert whole == brute_leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


def test_substitutions_are_tolerated(spark):
    ws = ITEM.split()
    changed = " ".join("zz" if i == 7 else w for i, w in enumerate(ws))
    r = leakage.overlaps(spark.createDataFrame([doc(1, changed)], DOCS), spark.createDataFrame([(1, ITEM, None, None)], ITEMS)).collect()
    assert [(x.exact_run, x.overlap_words, x.equal_words) for x in r] == [(7, 15, 14)]


def test_hashed_words_are_the_words():
    texts = ["Plain words_and 12 more", None, "", "Straße ﬁne ＡＢＣ x²", "so\u00adft\u200bly", "日本 語 𝐁old 𠀋", "é e\u0301 İ", " \n", "a" * 5000]
    flat, sizes = hash_words(texts)
    want = [w for t in texts for w in words(t)]
    assert sizes.tolist() == [len(words(t)) for t in texts] and len(flat) == len(want) and (flat != 0).all()
    assert len({(int(h), w) for h, w in zip(flat, want)}) == len(set(flat.tolist())) == len(set(want))


def brute_overlap(same, num, den):
    best = (0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            if same[i] and same[j - 1] and sum(same[i:j]) * den >= (j - i) * num:
                best = max(best, (j - i, sum(same[i:j])))
    return best


def test_longest_overlap_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        same = rng.random(rng.integers(1, 30)) < rng.choice([0.3, 0.7, 0.9])
        exact, length, equal = leakage.overlap(same, (4, 5))
        want = brute_overlap(same.tolist(), 4, 5)
        assert length == want[0] and (equal, exact) == (int(equal), max((len(r) for r in "".join("x" if s else " " for s in same).split()), default=0)) and equal * 5 >= length * 4


def test_a_scattered_tail_hides_no_exact_run(spark):
    """Twelve words copied and then every third word: the pair is reported for the copied run."""
    item = [f"i{k}" for k in range(30)]
    text = item[:12] + [w if k % 3 == 0 else f"x{k}" for k, w in enumerate(item[12:])]
    r = leakage.overlaps(spark.createDataFrame([doc(1, " ".join(text))], DOCS), spark.createDataFrame([(1, " ".join(item), None, None)], ITEMS)).collect()
    assert r[0].exact_run >= 12 and r[0].overlap_words >= 12


def test_no_items_or_documents(spark):
    assert leakage.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, ITEM, None, None)], ITEMS)).count() == 0
    assert leakage.leaks(spark.createDataFrame([doc(1, ITEM)], DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    with pytest.raises(ValueError, match="longer"):
        leakage.overlaps(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS), spec=leakage.LeakSpec(run=5))


TARGETS = "source string, target_weight double, max_repeats int, tokens int"


def mixture(spark, docs, targets, **kw):
    sel, rep = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), mixing.MixSpec(block=64, shard=16, **kw))
    return sel.collect(), {r.source: r for r in rep.collect()}


def test_shares_repeats_and_shortfall(spark):
    text = "The quick brown fox jumps over the lazy dog. " * 20
    docs = [doc(i, text, source=" Big ") for i in range(200)] + [doc(1000 + i, text, source="small") for i in range(20)] + [doc(2000 + i, text, source="other") for i in range(30)] + [doc(3000, None, source="big"), doc(3001, "", source="big"), doc(3002, text), doc(None, text, source="big")]
    docs += docs[:3]
    sel, rep = mixture(spark, docs, [("big", 1.0, 1, 1), ("SMALL", 1.0, 3, 1), ("missing", 2.0, 5, 1), (" ", 0.0, 1, 1)])
    assert {s for s, r in rep.items() if not r.reachable} == {"small", "missing"}
    assert all(r.uses <= (1 if r.source == "big" else 3) for r in sel)
    assert rep["small"].selected <= rep["small"].capacity == 3 * rep["small"].tokens
    assert abs(rep["big"].selected / rep["big"].goal - 0.25) < 0.06
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert len({r.doc_id for r in sel}) == len(sel) and not {3000, 3001} & {r.doc_id for r in sel}
    assert {(r.doc_id, r.uses, r.tokens_used) for r in mixture(spark, docs, [("big", 1.0, 1, 1), ("SMALL", 1.0, 3, 1), ("missing", 2.0, 5, 1), (" ", 0.0, 1, 1)])[0]} == {(r.doc_id, r.uses, r.tokens_used) for r in sel}


def test_mixing_nothing(spark):
    assert mixture(spark, [], [("a", 1.0, 1, 1)])[0] == []
    assert mixture(spark, [doc(1, "text", source="a")], []) == ([], {})
    sel, rep = mixture(spark, [doc(1, "text", source="a")], [("a", None, None, 1), ("b", float("nan"), -1, 1)])
    assert sel == [] and rep["a"].share == 0 and rep["a"].reachable


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(out.tolist()) == list(range(n))
    assert (mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != np.arange(1000)).mean() > 0.9


def test_running_total_over_pieces(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id", F.floor(F.col("id") / 10).alias("piece"), (F.col("id") + 1).alias("v"))
    got = {r.id: r.before_v for r in mixing.running_total(df, ["g"], "piece", ["id"], "v", "before_v").collect()}
    assert all(got[i] == sum(j + 1 for j in range(i) if j % 3 == i % 3) for i in range(100))


SENTENCES = {
    "en": "The scheduler restarted the service because the old limit was too low for this workload",
    "de": "Die Warteschlange wurde nach dem Neustart langsamer und niemand konnte den Grund dafür erklären",
    "fr": "La passerelle ne répondait plus pendant la nuit et personne ne savait pourquoi elle était lente",
    "es": "La copia de seguridad dejó de responder y nadie pudo explicar por qué estaba tan lenta ayer",
    "pt": "A cópia de segurança deixou de responder e ninguém conseguiu explicar por que estava tão lenta ontem",
    "nl": "De planner reageerde niet meer na de herstart en niemand kon uitleggen waarom het zo langzaam ging",
}


@pytest.fixture(scope="module")
def model(spark, data):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_sentences(spark, model):
    docs = [doc(i, t, None) for i, t in enumerate(SENTENCES.values())] + [doc(100 + i, t.upper(), None) for i, t in enumerate(SENTENCES.values())]
    got = {r.doc_id: r.lang for r in langid.document_languages(spark.createDataFrame(docs, DOCS), model=model).collect()}
    right = [got[i % 100 + (i // 100) * 100] == list(SENTENCES)[i % 100] for i in [*range(6), *range(100, 106)]]
    assert sum(right) >= 11


def test_agreement_with_labels(spark, model):
    """On labelled documents of another scale the main language is the label's, but for the labels that are wrong."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.document_languages(docs, model=model).where("label is not null and share > 0.8").collect()
    assert np.mean([r.lang == r.label for r in rows]) > 0.88


def test_mixed_documents_and_segments(spark, model):
    mixed = ". ".join([SENTENCES["en"], SENTENCES["en"], SENTENCES["de"], SENTENCES["de"]]) + "."
    df = spark.createDataFrame([doc(1, mixed, "en"), doc(2, SENTENCES["fr"], "French"), doc(3, SENTENCES["fr"], "fr-CA"), doc(4, SENTENCES["fr"], "xx"), doc(5, None, "en"), doc(6, "", "en"), doc(7, "12 34", "en"), doc(8, SENTENCES["nl"] + "\n" + "de " * 300_000, "nl"), doc(None, mixed, "en")], DOCS)
    langs = {(r.doc_id, r.lang) for r in langid.document_languages(df, model=model).where("share >= 0.2").collect()}
    assert {(1, "en"), (1, "de"), (2, "fr"), (3, "fr"), (4, "fr")} <= langs and not any(d in (5, 6) for d, _ in langs)
    segs = langid.segments(df.where("doc_id = 1"), model=model).orderBy("segment_no").collect()
    assert [s.lang for s in segs] == ["en", "en", "de", "de"] and all(0 <= s.confidence <= 1 for s in segs)


def test_spellings_of_labels(spark):
    given = {"en": "en", " EN_gb ": "en", "Deutsch": "de", "français": "fr", "pt-BR": "pt", "es_MX": "es", "dut": "nl", "zh": None, "": None, None: None, "en,de": None, "english please": None, "und": None}
    df = spark.createDataFrame([(k,) for k in given], "lang string")
    assert {r.lang: r.code for r in df.select("lang", langid.label_language(F.col("lang")).alias("code")).collect()} == given


def test_no_documents_or_labels(spark):
    assert langid.mislabelled(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([doc(1, SENTENCES["en"], None)], DOCS)
    assert langid.document_languages(df).count() == 1


def test_invisible_characters_part_no_words(spark, model):
    text = "­".join(SENTENCES["de"][i : i + 3] for i in range(0, len(SENTENCES["de"]), 3))
    df = spark.createDataFrame([doc(1, text, None), doc(2, SENTENCES["de"], None)], DOCS)
    got = {r.doc_id: (r.lang, r.words) for r in langid.document_languages(df, model=model).collect()}
    assert got[1] == got[2] and got[1][0] == "de"


def test_what_fits_no_language_is_rejected(spark, model):
    noise = "qzx vvkp jjwq xkcd zzqr pqqx wvvz kkjx"
    docs = [doc(1, noise, "en"), doc(2, f"{SENTENCES['fr']}\n{noise}\n{noise}\n{SENTENCES['fr']}", None), doc(3, SENTENCES["fr"], None)]
    df = spark.createDataFrame(docs, DOCS)
    rows = [(r.doc_id, r.lang, r.share) for r in langid.document_languages(df, model=model).collect()]
    assert [x for x in rows if x[0] == 1] == [(1, langid.UNKNOWN, 1.0)] and {x[1] for x in rows if x[0] == 2} >= {"fr"} and (3, "fr", 1.0) in rows
    assert {r.lang for r in langid.segments(df.where("doc_id = 1"), model=model).collect()} == {langid.UNKNOWN}


def test_short_segments_in_a_row_are_judged_as_one(spark, model):
    """A second language that comes in turns of three words only, under half of the words."""
    turns = "niemand weiß warum. wir warten noch. das ist schlecht. bitte schnell antworten. danke für alles."
    text = " ".join([SENTENCES["en"] + "."] * 2) + "\n" + turns.replace(". ", ".\n")
    got = {r.lang: r.share for r in langid.document_languages(spark.createDataFrame([doc(1, text, None)], DOCS), model=model).collect()}
    assert got.get("de", 0) >= 0.2 and got["en"] > 0.5


def test_languages_are_those_of_the_labels(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(langid.label_language(F.col("lang")).isin("de", "en"))
    two = langid.fit(docs)
    assert two.names == ("de", "en") and langid.labelled_sample(docs, langid.LangSpec(sample=5)) == langid.labelled_sample(docs.repartition(7), langid.LangSpec(sample=5))
    assert len(langid.labelled_sample(docs, langid.LangSpec(sample=5))) == 10
