"""The pipeline on a small table: each stage against a plain version on its own input, and odd rows in every stage."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from modsplit_spark.llm import decontamination as D
from modsplit_spark.llm import packing, toxicity
from modsplit_spark.llm.wordhash import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n, k=600):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(17)
    items = [_words(rng, n, 10**6) for n in (6, 9, 14, 30, 55)]
    passage = _words(rng, 60, 10**6)
    texts = []
    for d in range(240):
        w = _words(rng, rng.randrange(1, 120))
        if d % 3 == 0:
            w[rng.randrange(len(w)) : 0] = rng.choice(["vile scum filth", "filthy vilest scum"]).split()
        if d % 11 == 0:
            w += passage[rng.randrange(10) :]
        if d % 13 == 0:
            item = list(rng.choice(items))
            item[rng.randrange(len(item))] = "other"
            w += item
        texts.append(" ".join(w))
    texts += texts[:15] + [" ".join(["zz", *t.split()]) for t in texts[40:60]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, " ".join(_words(rng, 30) + items[2]), "en", "s", 0), (None, "clean words here", "en", "s", 0), (None, None, None, None, None), (900, "", "de", "s", 0), (900, "two rows of one id", "de", "s", 0), (901, "w " * 20_000, "en", None, 40_000)]
    home = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 3 == 0)) for d in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None), (9, "")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home, items


def _rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def _plain_repeats(rows):
    """Kept texts of (doc_id, text) rows, in the operator's order of documents; equal rows are one."""
    seen, out = set(), {}
    for key in rows:
        w = (key[1] or "").split()
        gone = set()
        for i in range(len(w) - 19):
            if (window := tuple(w[i : i + 20])) in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        out[key] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else key[1]
    return out


def test_every_stage_against_plain_versions(spark, small):
    home, items = small
    docs = spark.read.parquet(f"{home}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{home}/labels.parquet"))
    before = _rows(docs)
    kept = P.materialize(P.drop_toxic(spark, docs, home), "t")
    scores = dict(zip(before, toxicity.score_texts([toxicity._prepared(t) for _, t in before], model).tolist(), strict=True))
    assert _rows(kept) == Counter({k: n for k, n in before.items() if scores[k] < toxicity.THRESHOLD})
    labelled = [k for k in before if k[0] is not None and k[0] < 240]
    assert sum((k in _rows(kept)) == (k[0] % 3 != 0) for k in labelled) > 0.9 * len(labelled)

    one = P.materialize(P.drop_near_duplicates(spark, kept, home), "n")
    left, sets = list(_rows(one)), []
    for _, t in left:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert not [1 for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert not set(left) - set(_rows(kept)) and _rows(one).most_common(1)[0][1] == 1

    cut = P.materialize(P.drop_repeats(spark, one, home), "c")
    from modsplit_spark.llm.substring_dedup import row_key

    ordered = [(r["doc_id"], r["text"]) for r in one.select("*", *row_key(F.col("doc_id"), F.col("text"))).orderBy("doc", "crc", "hash").collect()]
    plain = _plain_repeats(ordered)
    assert _rows(cut) == Counter((d, plain[d, t]) for d, t in ordered if plain[d, t] != "" or t == "")

    clean = P.materialize(P.drop_leaks(spark, cut, home), "l")
    leaked = set()
    for d, t in _rows(cut):
        w = word_hashes([D._prepared(t)], D.MARKS)[0]
        for item in items:
            own = word_hashes([D._prepared(" ".join(item))], D.MARKS)[0]
            if len(w) and D.align(own, w)[0] <= D.edits(len(own)):
                leaked.add((d, t))
    assert _rows(clean) == Counter({k: n for k, n in _rows(cut).items() if k not in leaked}) and any(d is None for d, _ in leaked) and any(d is None for d, _ in _rows(clean))

    table = packing._table(None)
    want = Counter()
    for (d, t), n in _rows(clean).items():
        want[d] += n * (len(table.whole(t or "")) // 4 + 1)
    got = Counter()
    for r in P.pack_sequences(spark, clean, home).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert P.run(spark, home).agg(F.sum("length")).first()[0] == sum(want.values())


def test_stages_on_empty_tables_and_extra_columns(spark, small):
    home, _ = small
    docs = spark.read.parquet(f"{home}/documents.parquet")
    odd = docs.limit(40).selectExpr("*", "1 as doc", "2 as crc", "'x' as item", "3 as id", "4 as _key", "5 as component", "6 as length")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), home).count() == 0, name
        out = stage(spark, odd, home)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == list(P.COLUMNS), name
