"""The pipeline's near-dedup stage against all pairs at 5-word Jaccard similarity 0.8."""

import random

from corpus_pipeline import drop_near_duplicates
from modsplit_spark.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def _plain(rows):
    """Rows that stay: of each component the one with the least doc_id, null last."""
    sets, name = [_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and name[i] != name[j]:
                name = [name[j] if x == name[i] else x for x in name]
    groups = {}
    for i, n in enumerate(name):
        groups.setdefault(n, []).append(rows[i])
    return sorted(min(r[0] if r[0] is not None else 10**9 for r in g) for g in groups.values())


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for d in range(40):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(3, 200))]
        rows.append((100 * d, " ".join(base)))
        for k in range(1, 6):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((100 * d + k, " ".join(w)))
    hot = [f"h{i}" for i in range(300)]
    # A chain: neighbours are alike, ends are not; and a group in which all are near copies.
    rows += [(5000 + i, " ".join([f"c{j}" for j in range(5 * i, 5 * i + 100)])) for i in range(20)]
    rows += [(6000 + i, " ".join([*hot[:i], f"x{i}", *hot[i + 1 :]]).upper()) for i in range(150)]
    rows += [(7000, None), (7001, ""), (7002, " \n "), (None, "left alone here"), (8000, "one two"), (8001, "ONE  two")]
    full = [(*r, "en", "s", 0) for r in rows]
    got = drop_near_duplicates(spark, spark.createDataFrame(full, COLUMNS).repartition(5), "").collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else 10**9 for r in got) == _plain(rows)


def test_repeated_and_null_ids_fold(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50", "other")
    rows = [(1, text), (1, text), (1, near), (None, text), (None, near), (None, "alone"), (None, "alone"), (1, "not the same")]
    got = drop_near_duplicates(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS), "").collect()
    assert sorted((str(r["doc_id"]), "w" if r["text"] in (text, near) else r["text"]) for r in got) == [("1", "not the same"), ("1", "w"), ("None", "alone")]


def test_pairs_at_the_bound_share_a_band():
    rng = random.Random(7)
    texts = []
    for _ in range(300):
        w = [f"v{rng.randrange(10**6)}" for _ in range(94)]
        texts += [" ".join(w[:84]), " ".join([*w[:80], "a", "b", "c", "d"])]  # 76 of 84 shingles
        texts += [" ".join(w[:85]), " ".join(w[9:94])]  # 72 of 90 shingles: 0.8
    sets = near_copies.shingle_sets([t.encode() for t in texts])
    keys = near_copies.band_keys(sets)
    for i in range(0, len(texts), 2):
        assert near_copies.alike(sets[i], sets[i + 1]) and (keys[i] == keys[i + 1]).any()


def test_parity_maps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(11)
    for n in (0, 1, 5, 100, 3000):
        for edits in (0, 1, 3, 20, 400):
            w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            v = [f"n{i}" if rng.random() < edits / max(n, 1) else x for i, x in enumerate(w)]
            a, b = near_copies.shingle_sets([" ".join(w).encode(), " ".join(v).encode()])
            differ = sum(((int(x) ^ int(y)) % 2**64).bit_count() for x, y in zip(near_copies.parity_map(a), near_copies.parity_map(b), strict=True))
            assert differ <= len(set(a.tolist()) ^ set(b.tolist()))
            assert len(near_copies.parity_map(a)) == near_copies.MAP_WORDS


def test_group_just_short_of_alike_keeps_its_few_links(spark):
    # Each text replaces other words of one original, so that most pairs are at about 0.7; every tenth has a near copy of its own.
    rng = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((2 * k, " ".join(w)))
        if k % 10 == 0:
            w[rng.randrange(200)] = "again"
            rows.append((2 * k + 1, " ".join(w)))
    got = drop_near_duplicates(spark, spark.createDataFrame([(*r, "en", "s", 0) for r in rows], COLUMNS).repartition(3), "").collect()
    assert sorted(r["doc_id"] for r in got) == _plain(rows)


def test_late_pairs_lose_no_alike_pair(spark):
    # Members of a few buckets with sizes, shingles of their own and parity maps as their sets give them.
    rng = random.Random(13)
    texts, rows = [], []
    for bucket in range(3):
        base = [f"b{bucket}_{i}" for i in range(80)]
        for _ in range(40):
            w = base[: rng.randrange(66, 81)]
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}" if rng.random() < 0.7 else f"m{rng.randrange(4)}"
            texts.append((bucket, " ".join(w)))
    sets = near_copies.shingle_sets([t.encode() for _, t in texts])
    held = [set(x.tolist()) for x in sets]
    seen = {}
    for x in held:
        for h in x:
            seen[h] = seen.get(h, 0) + 1
    for i, (bucket, _) in enumerate(texts):
        size, common = len(held[i]), sum(seen[h] > 1 for h in held[i])
        reach = 9 * common // 4 - size
        rows.append((bucket, i, size, i // 2, rng.random() < 0.8, reach, reach >= size, near_copies.parity_map(sets[i]).tolist()))
    schema = "bucket long, id long, size long, component long, stray boolean, reach long, open boolean, parity array<long>"
    got = [frozenset(r) for r in near_copies.late_pairs(spark.createDataFrame(rows, schema)).collect()]
    wanted = {
        frozenset((i, j))
        for i in range(len(rows))
        for j in range(i)
        if rows[i][0] == rows[j][0] and rows[i][3] != rows[j][3] and (rows[i][4] or rows[j][4]) and 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])
    }
    assert len(wanted) > 50 and wanted <= set(got) and len(got) == len(set(got))


def test_texts_with_a_ninth_of_their_own_meet_no_equals(spark):
    rows = [(1, i, 180, i, i > 0, 170 + (i % 50 == 0) * 20, i % 50 == 0, [0] * near_copies.MAP_WORDS) for i in range(1000)]
    schema = "bucket long, id long, size long, component long, stray boolean, reach long, open boolean, parity array<long>"
    members = spark.createDataFrame(rows, schema)
    assert near_copies.reaching(members).count() == 20 and near_copies.late_pairs(members).count() == 190
