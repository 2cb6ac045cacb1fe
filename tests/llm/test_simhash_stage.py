"""The pipeline's near-dedup stage goes through SimHash: neighbours against all pairs, and links that MinHash bands don't offer."""

import random

import corpus_pipeline
from modsplit_spark.llm import near_copies, simhash


def _differ(a, b):
    return ((a ^ b) % 2**64).bit_count()


def _planted(rng, groups, most):
    prints = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(4)):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, most + 1))))
    return sorted(p - 2**64 if p >> 63 else p for p in prints)


def test_every_print_with_another_in_reach_gets_one(spark):
    prints = _planted(random.Random(5), 300, 7)
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    for t in (3, simhash.RADIUS):
        got = simhash.neighbours(frame, t).collect()
        assert all(r["hub"] != r["print"] and _differ(r["hub"], r["print"]) <= t for r in got)
        wanted = {p for p in prints if any(p != q and _differ(p, q) <= t for q in prints)}
        assert len(got) == len(wanted) and {r["print"] for r in got} == wanted and len(wanted) > 100


def test_crowded_keys_meet_their_hub_alone(spark):
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ 1 << b for b in range(60)]
    got = simhash.neighbours(spark.createDataFrame([(p,) for p in prints], "print long"), crowd=8).collect()
    assert {r["print"] for r in got} >= set(prints) - {base} and len(got) <= len(prints) and all(_differ(r["hub"], r["print"]) <= simhash.RADIUS for r in got)


def test_simhash_links_what_no_band_offers(spark):
    # No two texts share a band, so that the links are SimHash's; the exact check still holds back what is not alike.
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        near = list(base)
        near[rng.randrange(300)] = "other"
        texts += [" ".join(base), " ".join(near)]
    texts += ["", "  ", "\n"]
    sets = near_copies.shingle_sets([t.encode() for t in texts])
    prints = [simhash.set_print(s) for s in sets]
    prints[1] = prints[2]  # equal fingerprints of texts that are not alike: the first stands for both, so that 2 and 3 are left to the bands
    rows = [(i, len(s), [i * near_copies.BANDS + b for b in range(near_copies.BANDS)], p) for i, (s, p) in enumerate(zip(sets, prints, strict=True))]
    held = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = near_copies.components(spark.createDataFrame(rows, "id long, size long, bands array<long>, print long"), lambda ids: held.join(ids, "id"), simhash.neighbours)
    found = {r["node"]: r["component"] for r in got.collect()}
    reach = {i for i in range(4, 60) if _differ(prints[i], prints[i ^ 1]) <= simhash.RADIUS}
    assert len(reach) > 40 and found == {i: i & ~1 for i in reach} | {60: 60, 61: 60, 62: 60}


def test_the_stage_runs_simhash(spark, monkeypatch):
    seen = []
    real = simhash.neighbours
    monkeypatch.setattr(simhash, "neighbours", lambda prints: seen.append(prints.count()) or real(prints))
    rows = [(1, "a b c d e f g", "en", "s", 0), (2, "A b c d e f g", "en", "s", 0), (3, "other words", "en", "s", 0)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3] and seen == [2]
