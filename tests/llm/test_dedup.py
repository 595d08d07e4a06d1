"""Exact, substring and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessella.llm import exact_dedup, near_dedup, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def prose(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def copies(odd_rows):
    rnd = random.Random(4)
    texts = [prose(rnd, 80) for _ in range(12)]
    rows = odd_rows + [(100 + k, rnd.choice(texts)) for k in range(80)]
    return rows


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("hot", [False, True])
def test_exact(docs, copies, hot, monkeypatch):
    if hot:  # every repeated text is salted
        monkeypatch.setattr(exact_dedup, "_hot", lambda keys, rows: [r[0] for r in keys.groupBy("_h").count().filter("count > 1").select("_h").collect()])
    got = exact_dedup.verdicts(docs(copies)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == exact(copies)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({t or "" for _, t in copies})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_without_identifiers(docs, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(exact_dedup, "_hot", lambda keys, rows: [r[0] for r in keys.groupBy("_h").count().filter("count > 1").select("_h").collect()])
    rows = [(None, "a"), (None, "a"), (5, "a"), (7, "a"), (7, "a"), (None, "b"), (None, "b"), (3, "c")]
    got = exact_dedup.verdicts(docs(rows)).collect()
    assert sorted((r.text_sha256[:4], r.keep_id or 0, r.group_size) for r in got) == sorted((hashlib.sha256(t.encode()).hexdigest()[:4], k, n) for t, k, n in [("a", 7, 5)] * 5 + [("b", 0, 2)] * 2 + [("c", 3, 1)])
    assert sorted((r.doc_id or 0) for r in got if r.kept) == [0, 3, 7]


def test_exact_smallest_and_normalised(docs):
    from pyspark.sql import functions as F

    rows = [(1, "a"), (2, "A"), (3, "b")]
    got = exact_dedup.verdicts(docs(rows), normalise=F.lower, keep="min").collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_exact_keeps_columns(docs, clashing, odd_rows):
    df = clashing(odd_rows)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    texts = [r.text for r in out.collect()]
    assert len(texts) == len({t or "" for _, t in odd_rows})
    assert exact_dedup.drop_copies(docs([])).count() == 0 == exact_dedup.verdicts(docs([])).count()


def without_repeats(rows, window):
    first = {}
    split = [(i, WORDS(t or "")) for i, t in rows]
    for i, words in sorted((x for x in split if x[0] is not None), key=lambda x: x[0]):
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), i)
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if i is not None and first[tuple(words[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cleaned(df):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("parts", [4096, 3])
def test_substring(docs, parts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_PARTS", parts)
    rnd = random.Random(7)
    shared = [prose(rnd, 70) for _ in range(3)] + [prose(rnd, 50), prose(rnd, 49)]
    rows = [(k, " ".join(x for _ in range(rnd.randrange(1, 4)) for x in (prose(rnd, rnd.randrange(0, 60)), rnd.choice(shared)))) for k in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1].replace(" ", "\n")), (52, None), (53, ""), (54, "one " * 200), (55, "one " * 120), (56, shared[4])]
    assert cleaned(docs(rows)) == without_repeats(rows, 50)


@pytest.mark.parametrize("parts", [4096, 2])
def test_substring_of_repeated_and_missing_identifiers(docs, parts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_PARTS", parts)
    rnd = random.Random(13)
    text, other, alone, shared = (prose(rnd, n) for n in (80, 70, 60, 55))
    rows = [(1, text), (2, text), (2, alone), (2, f"{other} {shared}"), (2, f"{other} {shared}"), (3, shared), (None, text), (None, shared), (4, alone), (4, text)]
    assert cleaned(docs(rows)) == without_repeats(rows, 50)


def test_substring_long_texts_in_parts(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    monkeypatch.setattr(substring_dedup.runs, "__defaults__", (700,))
    rnd = random.Random(8)
    shared = prose(rnd, 300)
    rows = [(1, f"{prose(rnd, 900)} {shared} {prose(rnd, 500)}"), (2, f"{prose(rnd, 333)} {shared}"), (3, shared)]
    got = substring_dedup.remove_repeats(docs(rows), outputs=True).collect()
    assert cleaned(docs(rows)) == without_repeats(rows, 50)
    assert {r.id: r.kept for r in got}[3] == ""


def test_substring_empty_table(docs, clashing, odd_rows):
    assert substring_dedup.remove_repeats(docs([])).count() == 0
    assert substring_dedup.remove_repeats(clashing(odd_rows)).count() == len(odd_rows)


def fingerprint(text):
    words = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def reach(prints):
    """Smallest identifier reachable over links of 2 bits or fewer."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("bucket", [32, 3])
def test_simhash(docs, odd_rows, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(9)
    base = [prose(rnd, 300).split() for _ in range(4)]
    rows = [r for r in odd_rows if r[0] != 10]
    for k in range(60):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.classes(docs(rows)).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == reach(prints)


def test_links_of_clusters_stay_whole(spark, monkeypatch):
    rnd = random.Random(10)
    prints = {}
    for c in range(6):
        at = rnd.getrandbits(64)
        for _ in range(60):
            at ^= 1 << rnd.randrange(64) if rnd.random() < 0.8 else (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            prints.setdefault(at, len(prints))
    by_rep = {rep: fp for fp, rep in prints.items()}
    df = spark.createDataFrame([(fp - (1 << 64) * (fp >> 63), rep) for fp, rep in prints.items()], "fp long, rep long")
    for bucket in (2, 32):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
        assert {i: found.get(i, i) for i in by_rep} == reach(by_rep)


def test_pairs_fall_from_pivot_to_pivot(spark):
    rnd = random.Random(14)
    prints = {rnd.getrandbits(64): k for k in range(300)}
    for k, at in enumerate(list(prints)[:50]):
        prints.setdefault(at ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)), 300 + k)
    df = spark.createDataFrame([(simhash.signed(fp), rep) for fp, rep in prints.items()], "fp long, rep long")
    table = {r.rep: r for r in simhash._table(df).collect()}
    for fp, rep in prints.items():  # the table holds the distances to all pivots
        own = [table[rep].d, *(table[rep].d + 8 - 2 * (table[rep][f"g{g}"] >> 4 * k & 15) for g in range(4) for k in range(8))]
        assert own == [(fp ^ p).bit_count() for p in simhash.pivots()]
    steps = simhash.funnel(df)
    counts = [n for _, n in steps]
    assert counts[:-1] == sorted(counts[:-1], reverse=True) and counts[-2] >= counts[-1] >= 50
    assert simhash.links(df).count() == sum((a ^ b).bit_count() <= 2 for a in prints for b in prints if a < b)


def test_simhash_of_odd_tables(docs, clashing, odd_rows):
    found = {r.id: r.component for r in simhash.classes(clashing(odd_rows)).collect()}
    assert {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 11: 6, 9: 9} == found
    assert simhash.classes(docs([])).count() == 0


def shingle_sets(rows):
    split = {i: WORDS((t or "").lower()) for i, t in rows}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}


def near_by_brute_force(rows):
    """Smallest identifier reachable over pairs of similarity 0.8 or more."""
    sets = shingle_sets(rows)
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return label


@pytest.mark.parametrize("hot", [1000, 2])
def test_near_copies_of_similarity_08(docs, odd_rows, hot, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rnd = random.Random(11)
    base = [prose(rnd, n).split() for n in (20, 60, 250, 450)]
    rows = [r for r in odd_rows if r[0] != 10]
    for k in range(120):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(1 + len(words) // 30)):
            words[rnd.randrange(len(words))] = f"changed{rnd.randrange(9)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(300 + k, prose(rnd, 200) + " one very common line of a few words") for k in range(40)]
    want = near_by_brute_force(rows)
    got = {r.id: r.component for r in near_dedup.classes(docs(rows)).collect()}
    assert got == want
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(None, docs(rows), None).collect()}
    assert kept == {i for i, c in want.items() if c == i}


@pytest.mark.parametrize("crowd, carried, hot", [(3, 512, 1000), (3, 6, 4), (60, 512, 1000)])
def test_crowds_of_near_copies(docs, crowd, carried, hot, monkeypatch):
    """Groups around texts that are not in the table, edited little and much, at shared and at own places; a crowded key and none."""
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "CARRIED", carried)
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "HOT_PARTS", 100_000)
    rnd = random.Random(21)
    rows = []
    for g, n in enumerate((40, 90, 150)):
        base = prose(rnd, n).split()
        for k in range(60):
            words = list(base)
            for _ in range(rnd.choice((0, 1, 2, n // 30, n // 22, n // 15)) if g < 2 else n // 35 + rnd.randrange(3)):
                at = rnd.choice((7, 21, rnd.randrange(n), rnd.randrange(n)))
                words[at] = rnd.choice((f"other{rnd.randrange(3)}", f"own{rnd.randrange(10**6)}"))
            rows.append((1000 * g + k, " ".join(words[: n - rnd.choice((0, 0, 0, 2, n // 8))])))
    got = {r.id: r.component for r in near_dedup.classes(docs(rows)).collect()}
    want = near_by_brute_force(rows)
    assert got == want
    assert len(set(want.values())) > 20


def test_crowds_keep_their_smallest_node(docs, monkeypatch):
    """Copies with an own word each share crowded keys only; the node that names the cluster is linked like the others."""
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    rnd = random.Random(8)
    base = prose(rnd, 120).split()
    rows = [(k, " ".join([*base[: 9 * k + 5], f"own{k}", *base[9 * k + 6 :]])) for k in range(12)]
    got = {r.id: r.component for r in near_dedup.classes(docs(rows)).collect()}
    assert got == near_by_brute_force(rows) == dict.fromkeys(range(12), 0)


def test_crowds_carry_shared_differences_only(docs, monkeypatch):
    """What one node alone has makes no rows of a join and is not carried; it counts in the sizes."""
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    rnd, seen, durable = random.Random(22), [], near_dedup.durable

    def watched(df):
        out = durable(df)
        if {"x", "d", "size"} <= set(out.columns):
            seen.extend(out.select("d", "size").collect())
        return out

    monkeypatch.setattr(near_dedup, "durable", watched)
    base = prose(rnd, 80).split()
    rows = [(k, " ".join([*base[:30], f"own{k}", *base[31:60], f"other{k % 2}", *base[61:]][: 80 - k % 3])) for k in range(9)]
    got = {r.id: r.component for r in near_dedup.classes(docs(rows)).collect()}
    assert got == near_by_brute_force(rows)
    assert seen and all(len(r["d"]) < r["size"] for r in seen)


def test_components_of_stars_and_paths(spark):
    """Stars that are given stay as they are; paths and rings become stars on their smallest nodes."""
    def found(edges):
        return {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}

    assert found([(5, 1), (4, 1), (9, 7), (7, 9), (3, 3)]) == {5: 1, 4: 1, 9: 7}
    assert found([(k, k + 1) for k in range(40)] + [(50, 51), (51, 52), (52, 50)]) == {**dict.fromkeys(range(1, 41), 0), 51: 50, 52: 50}
    assert found([]) == {}


def test_signatures_agree_as_often_as_counted(spark):
    rnd = random.Random(15)
    rows = []
    for k in range(40):
        a = bytes(rnd.randrange(256) for _ in range(128))
        b = bytes(x if rnd.random() < 0.6 else rnd.choice([0, 1, 127, 128, 255, x ^ 128]) for x in a)
        rows.append((k, *(np.frombuffer(x, np.int64).tolist() for x in (a, b)), sum(x == y for x, y in zip(a, b))))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>, n long")
    assert all(r.alike == (r.n >= near_dedup.LEAST) for r in df.select("n", near_dedup._alike("a", "b").alias("alike")).collect())
    assert {r[3] >= near_dedup.LEAST for r in rows} == {True, False}


def test_near_copies_keep_columns(docs, clashing, odd_rows):
    df = clashing(odd_rows)
    out = near_dedup.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [1, 4, 6, 9]
    assert near_dedup.drop_near_copies(docs([])).count() == 0
