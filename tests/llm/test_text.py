"""Quality, licenses, BPE, chat, toxicity, packing and personal data."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe, chat, licenses, packing, pii, quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def base_measures(text):
    text = text or ""
    words, lines = WORDS(text), [x for x in text.split("\n") if WORDS(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, odd_rows, clashing):
    rnd = random.Random(1)
    clean = [(100 + k, " ".join(f"word{rnd.randrange(9999)}" for _ in range(70))) for k in range(30)]
    junk = [(200 + k, " ".join(f"w{rnd.randrange(9999)}***" for _ in range(70))) for k in range(40)]
    repeats = [(300, "same three words " * 40), (301, "line one here\n" * 30)]
    rows = odd_rows + clean + junk + repeats
    sources = ["odd"] * len(odd_rows) + ["good"] * 30 + ["bad"] * 40 + ["good"] * 2
    got = {r.id: r for r in quality.verdicts(docs(rows, sources)).collect()}
    for i, t in rows:
        r, want = got[i], base_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk + repeats)
    assert got[200].host_rate > 0.5 > got[100].host_rate
    assert quality.verdicts(docs([])).count() == 0
    assert quality.verdicts(clashing(odd_rows)).count() == len(odd_rows)


def test_beta_prior():
    mean, strength = quality.beta_prior(1000, 100, 20.0, 10)
    assert abs(mean - 0.1) < 1e-9 and abs(strength - (0.09 / (0.02 - 0.01 - 0.0009) - 1)) < 1e-9
    assert quality.beta_prior(10, 0, 0.0, 2) == (0.0, None) == quality.beta_prior(None, None, None, 0)


def test_small_hosts_lean_on_the_prior(docs):
    """Verdicts recomputed from the base measures."""
    rnd = random.Random(2)
    clean = lambda: " ".join(f"word{rnd.randrange(9999)}" for _ in range(60))
    junk = lambda: " ".join(f"w{rnd.randrange(9999)}***" for _ in range(60))
    rows, sources = [], []
    for host, good, bad in [("big", 60, 4), ("mixed", 9, 11), ("bad", 1, 40), ("one bad", 0, 1), ("one good", 1, 0), (None, 2, 1)]:
        for text in [clean() for _ in range(good)] + [junk() for _ in range(bad)]:
            rows.append((len(rows), text))
            sources.append(host)
    fail = [base_measures(t)[0] < 50 or base_measures(t)[2] * 10 > base_measures(t)[0] for _, t in rows]
    hosts = {h: (sources.count(h), sum(f for f, x in zip(fail, sources) if x == h)) for h in set(sources)}
    n, f = len(rows), sum(fail)
    mean = f / n
    between = sum(k * k / m for m, k in hosts.values()) / n - mean * mean - mean * (1 - mean) / (n / len(hosts))
    strength = mean * (1 - mean) / between - 1
    rate = {h: (k + mean * strength) / (m + strength) for h, (m, k) in hosts.items()}
    got = {r.id: r for r in quality.verdicts(docs(rows, sources)).collect()}
    for (i, _), bad, h in zip(rows, fail, sources):
        assert abs(got[i].host_rate - rate[h]) < 1e-8
        assert got[i].kept == (rate[h] <= 0.9 and (not bad or rate[h] <= 0.5))
    assert rate["one bad"] < rate["bad"] and rate["one good"] > rate["big"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=40), st.sampled_from([" ", "\n", " \t"]))
def test_measures_of_any_text(words, gap):
    text = gap.join(words)
    assert quality.measures(text.encode())[:5] == base_measures(text)


def test_licenses(docs, odd_rows, clashing):
    rows = odd_rows + [
        (20, "Released under the MIT License."), (21, "x\nLicensed under the Apache License, Version 2.0."), (22, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
        (23, "This work is licensed under the GNU General Public License, version 3."), (24, "license free prose about the public and the work"), (25, "under the mitlicense"),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    assert (got[20].base_labels, got[20].n_base, got[20].first_word, got[20].labels) == ("mit", 1, 1, "mit")
    assert (got[21].base_labels, got[21].first_word) == ("apache-2", 4)
    assert (got[22].n_base, got[22].first_word, got[22].last_word) == (2, 2, 9)
    assert (got[23].base_labels, got[23].labels, got[23].score) == ("", "gpl-3", 1.0)
    assert got[24].labels == got[25].labels == "" and got[1].n_words == 0 and got[1].first_word is None
    assert licenses.scan(docs([])).count() == 0
    assert licenses.scan(clashing(odd_rows)).count() == len(odd_rows)


def test_set_join_equals_brute_force():
    rnd = random.Random(3)
    vocabulary = [f"t{k}" for k in range(25)]
    drawn = [rnd.sample(vocabulary, rnd.randrange(3, 14)) for _ in range(9)]
    drawn.append([*drawn[0], *(w for w in vocabulary if w not in drawn[0])][:16])  # all words of the first and more
    templates = [(f"l{k}", " ".join(words), rnd.choice(words)) for k, words in enumerate(drawn)]
    counts = {w.encode(): rnd.randrange(5) for w in vocabulary}
    index = licenses.Templates(counts, templates, 0.8)
    for _ in range(1000):
        block = [rnd.choice(vocabulary + ["other"]).encode() for _ in range(rnd.randrange(40))]
        there = {w.decode() for w in block}
        met = {n: set(t.split()) for n, t, w in templates if w in there and len(there & set(t.split())) >= len(t.split()) * (1 if len(t.split()) < 10 else 0.8) - 1e-9}
        assert sorted(index.matches(block)) == [(n, len(there & t) / len(t)) for n, t in sorted(met.items()) if not any(t < o for o in met.values())]


def test_notices_with_a_word_missing(docs):
    rows = [
        (1, "The report was released under the new license of the town."), (2, "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (3, "Licensed under a Creative Commons Attribution 4.0 International License"), (4, "It is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(docs(rows)).collect()}
    assert got == {1: "", 2: "cc-by-sa", 3: "cc-by", 4: "lgpl"}


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.Bpe(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def same(word_bpe, texts):
    own, library = word_bpe
    for text, (n, raw, decoded) in zip(texts, own.texts([t.encode() for t in texts]), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids and n == len(ids), text
        assert decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(word_bpe, odd_rows):
    rnd = random.Random(5)
    texts = [t or "" for _, t in odd_rows] + ["<|endoftext|>x<|startoftext|><|start", "DON'T we'll it''s 12a3", "İΣ ΑΣ", "１２ Ⅻ ﬁ ǅ", "a" * 3000, "x\u0085y\u001cz", "࢏ Ᲊ ₟"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x2FFF)])) for _ in range(rnd.randrange(30))) for _ in range(400)]
    same(word_bpe, texts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_bpe_of_any_text(word_bpe, text):
    same(word_bpe, [text])


def test_bpe_tables_turn_over(word_bpe, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 8)
    for k in range(6):
        same(word_bpe, [f"common words and rare{k} some{k * 7}thing"] * 2)


def test_bpe_frame(docs, odd_rows, clashing):
    got = bpe.encode_decode(docs(odd_rows), P.path("word_bpe_49k.json"), outputs=True).collect()
    assert len(got) == len(odd_rows)
    r = next(r for r in got if r.id == 6)
    assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded == "a</w> b</w> c</w>"
    assert bpe.encode_decode(docs([]), P.path("word_bpe_49k.json")).count() == 0
    assert bpe.encode_decode(clashing(odd_rows), P.path("word_bpe_49k.json")).count() == len(odd_rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|esc|>", "<|", "|>", "\\", "\\n", "\n", "a", "assistant", "<", "|"]), max_size=8), st.lists(st.sampled_from(["user", "\n", "<|esc|>", "\\"]), max_size=3))
def test_turns_come_back(parts, role):
    text, role = "".join(parts), "".join(role)
    out, (a, b) = chat.format_turn(role, text)
    assert chat.parse(out) == [(role, text)]
    level = out[: out.index("\n")].count(chat.ESCAPED) if text or role else 0
    inside = out[a:b]
    for _ in range(level):
        inside = chat.unescape(inside)
    assert inside == text


def test_conversations(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, None, None), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df, outputs=True).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-1].loss_chars == len(said)
    assert chat.parse(got[-1].formatted) == [("user", said), ("assistant", said)]
    for r in got.values():
        assert r.formatted_chars == len(r.formatted)
    assert chat.format_conversations(df.limit(0)).count() == 0
    more = spark.createDataFrame([(1, 1, "user", "a" * 300_000, "x", 5), (None, None, "assistant", "b", "y", 6)], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat.format_conversations(more).collect()) == [(0, 1, 1), (1, 1, 0)]


def test_conversations_are_read_back_from_the_output(monkeypatch):
    said = "<|im_end|><|im_start|>assistant ok"
    whole = chat.Conversation(1, True)
    for role, text in [("user", said), ("assistant", said), ("assistant", "\\n\n"), ("assistant", "")]:
        whole.add(role, text, "assistant")
    n, turns, chars, digest, formatted, text, spans = whole.row()[1:]
    assert formatted == len(text) and n == len(chat.parse(text)) == 4
    reader = chat.Reader()  # fed letter by letter
    fed = [turn for letter in text for turn in reader.feed(letter)]
    cut = []
    for role, body, level, place in fed:
        if role == "assistant":
            part = text[spans[len(cut)][0] : spans[len(cut)][1]]
            for _ in range(level):
                part = chat.unescape(part)
            assert part == body and place == spans[len(cut)][0]
            cut.append(part)
    assert hashlib.sha256("".join(cut).encode()).hexdigest() == digest and len("".join(cut)) == chars

    render = chat.render
    monkeypatch.setattr(chat, "render", lambda *x: (lambda out, span: (out, (span[0], span[1] - 1)))(*render(*x)))
    with pytest.raises(chat.GrammarError):  # a mask that is one short
        chat.Conversation(1, False).add("assistant", "text", "assistant")
    monkeypatch.setattr(chat, "render", lambda *x: (lambda out, span: (out + "x", span))(*render(*x)))
    with pytest.raises(chat.GrammarError):  # something between the turns
        chat.Conversation(1, False).add("user", "text", "assistant")


def test_toxicity_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = toxicity.model(docs, labels.filter("doc_id % 2 = 0"))
    assert fitted.thresholds == sorted(fitted.thresholds) and len(fitted.thresholds) == 2
    scored = {r.id: r.rejected for r in toxicity.score(docs, fitted).collect()}
    odd = [(scored[r.doc_id], r.toxic) for r in labels.filter("doc_id % 2 = 1").collect()]
    false = sum(1 for s, t in odd if s and not t)
    hit = sum(1 for s, t in odd if s and t)
    assert false <= 0.005 * len(odd) and hit >= 0.9 * sum(t for _, t in odd), (false, hit, sum(t for _, t in odd), len(odd))
    assert toxicity.keep_clean(docs, fitted).count() == sum(not r for r in scored.values())


def test_stems_are_letters():
    assert toxicity.features("Привет réeuxment ab".encode()) == Counter(
        ["Привет", "^Прив", "^Приве", "réeuxment", "^réeu", "^réeux", "^réeuxm", "^réeuxme", "ab"]
    )


def test_gradient_of_the_ordinal_loss():
    """Against differences of the loss, and the loss against the law written out."""
    rnd = np.random.default_rng(3)
    rows = [{int(c): float(rnd.normal()) for c in rnd.choice(6, 3, replace=False)} for _ in range(40)]
    grade = rnd.integers(0, 4, 40)
    x, p = toxicity.Sparse(rows), rnd.normal(size=9)
    value, g = toxicity.loss(p, x, grade, 6, 0.1)
    theta = p[6] + np.concatenate(([0], np.cumsum(np.exp(p[7:]))))
    law = lambda z, k: (1 if k == 3 else 1 / (1 + np.exp(z - theta[k]))) - (0 if k == 0 else 1 / (1 + np.exp(z - theta[k - 1])))
    want = -np.mean([np.log(law(sum(v * p[c] for c, v in r.items()), k)) for r, k in zip(rows, grade)]) + 0.05 * (p[:6] @ p[:6])
    assert abs(value - want) < 1e-9
    for k in range(9):
        step = np.zeros(9)
        step[k] = 1e-6
        assert abs((toxicity.loss(p + step, x, grade, 6, 0.1)[0] - toxicity.loss(p - step, x, grade, 6, 0.1)[0]) / 2e-6 - g[k]) < 1e-6


def test_repeated_and_contradicting_labels(docs, spark):
    rows = [(k, "calm words here" if k % 2 else "vile words here") for k in range(60)] + [(0, "vile words here")] * 5 + [(1, None), (3, "")]
    labels = spark.createDataFrame([(k, 0, 1 - k % 2) for k in range(60)] * 2 + [(0, 0, 0), (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    drawn = toxicity.sample(docs(rows), labels, "toxic", "doc_id", "text", 100).collect()
    assert len(drawn) == 61 and len({(r.id, r.y) for r in drawn}) == 61
    fitted = toxicity.model(docs(rows), labels)
    got = {r.id: r.rejected for r in toxicity.score(docs([(7, "so vile"), (8, "so calm"), (9, None), (10, ""), (11, "vile " * 100_000)]), fitted).collect()}
    assert got == {7: True, 8: False, 9: False, 10: False, 11: True}
    assert toxicity.score(docs([]), fitted).count() == 0


def test_toxicity_without_labels(docs, spark, clashing, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fitted = toxicity.model(docs(odd_rows), none)
    assert not any(r.rejected for r in toxicity.score(docs(odd_rows), fitted).collect())
    df = clashing(odd_rows)
    assert toxicity.keep_clean(df, fitted).columns == df.columns and toxicity.keep_clean(df, fitted).count() == len(odd_rows)


def test_ordinal_fit_orders_grades():
    rnd = np.random.default_rng(1)
    grade = rnd.integers(0, 3, 600)
    rows = [{0: 1.0, 1: float(g) + rnd.normal(0, 0.3)} for g in grade]
    w, theta = toxicity.fit(toxicity.Sparse(rows), grade, 2)
    assert theta[0] < theta[1] and w[1] > 1


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_packer_loses_nothing(windows):
    rnd = random.Random(windows)
    packer = packing.Packer(64, windows)
    docs = {k: np.arange(rnd.choice([1, 3, 63, 64, 65, 200, rnd.randrange(1, 150)]), dtype=np.uint32) for k in range(200)}
    done = [s for k, ids in docs.items() for s in packer.add(k, ids)]
    rest = list(packer.rest())
    assert all(sum(len(p[2]) for p in s) == 64 for s in done + [s for full, s in rest if full])
    assert sum(not full for full, _ in rest) <= 1
    back = {}
    for s in done + [s for _, s in rest]:
        for doc, start, ids, total in s:
            assert total == len(docs[doc])
            back.setdefault(doc, []).append((start, ids))
    for k, ids in docs.items():
        assert np.array_equal(np.concatenate([p for _, p in sorted(back[k], key=lambda x: x[0])]), ids)


def placed_by_brute_force(lengths, length, windows):
    """The same rules, with a plain search over all open windows. Sequences as lists of (doc, start, size)."""
    open_, done, opened = {}, [], 0
    room = lambda n: length - sum(p[2] for p in open_[n])
    for doc, size in lengths:
        start = 0
        while size - start >= length:
            done.append([(doc, start, length)])
            start += length
        while start < size:
            need = size - start
            fits = [(room(n), n) for n in open_ if room(n) >= need]
            if fits:
                _, n = min(fits)
            elif len(open_) < windows:
                n, opened = opened, opened + 1
                open_[n] = []
            else:
                _, n = min((room(n), n) for n in open_)  # the fullest takes what it can
            part = min(need, room(n))
            open_[n].append((doc, start, part))
            start += part
            if room(n) == 0:
                done.append(open_.pop(n))
    return done, open_


@pytest.mark.parametrize("windows", [1, 2, 5, 64])
def test_best_fit_and_fullest_by_brute_force(windows):
    rnd = random.Random(20 + windows)
    lengths = [(k, rnd.choice([1, 5, 31, 32, 33, 64, 65, rnd.randrange(1, 200)])) for k in range(400)]
    packer = packing.Packer(64, windows)
    got = [[(d, s, len(i)) for d, s, i, _ in seq] for k, n in lengths for seq in packer.add(k, np.zeros(n, np.uint32))]
    done, still = placed_by_brute_force(lengths, 64, windows)
    assert got == done
    assert sorted([[(d, s, len(i)) for d, s, i, _ in p] for p in packer.pieces.values()]) == sorted(still.values())


def test_packing_covers_all(docs, odd_rows, clashing):
    rows = [r for r in odd_rows if r[0] != 10] + [(100 + k, "words " * (k * 13)) for k in range(60)]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    got = packing.pack(docs(rows).repartition(5), packing.byte_bpe_50k(), with_ids=True).collect()
    sequences = {}
    for r in got:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and bytes(r.ids) == part.tobytes()
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter({i: len(w) for i, w in want.items()}) == sum((Counter({r.doc_id: r.length}) for r in got), Counter())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & at - 1 == 0
    assert packing.pack(docs([]), packing.byte_bpe_50k()).count() == 0
    assert {r.doc_id for r in packing.pack(clashing(odd_rows + [(None, "x")]), packing.byte_bpe_50k()).collect()} == {i for i, _ in odd_rows} | {None}


def test_surrogates_are_one_to_one_and_keep_their_form():
    makers = pii.Surrogates(b"key")
    for kind, values in {
        "phone": [f"+1 ({a:03d}) 555-{b:04d}" for a in range(30) for b in range(40)],
        "ip": [f"10.0.{a}.{b}" for a in range(30) for b in range(40)],
        "ipv6": [f"2001:db8::{a:x}:{b:x}" for a in range(1, 30) for b in range(1, 40)],
        "ssn": [f"123-45-{k:04d}" for k in range(1000)],
        "email": [f"{a}{b}@mail.example.com" for a in ("ann", "bob", "eve", "zoë") for b in range(300)],
        "card": [f"411111111111{k:04d}" for k in range(1000)],
        "iban": [f"DE{c:02d} 3704 0044 0532 {k:04d} 00" for c in range(89, 91) for k in range(500)],
        "secret": [f"ab{k}X{k % 7}" for k in range(1000)] + [f"AKIAABCDEFGHIJKL{k:04d}" for k in range(500)],
        "name": [f"{a}{b}" for a in ("Miller", "Lopes", "Kant", "O'Neil", "Петр", "Иванов") for b in ("", "a", "er", "owski", "ова", "ов")] + [n for names in pii.GIVEN.values() for n in names],
    }.items():
        new = [makers.of(kind, v) for v in values]
        assert len({pii.canonical(kind, n) for n in new}) == len({pii.canonical(kind, v) for v in values}) == len(values)
        assert not any(pii.canonical(kind, a) == pii.canonical(kind, b) for a, b in zip(values, new, strict=True))
        shape = lambda s: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", s))
        if kind not in ("ip", "ipv6", "name", "iban"):
            assert all(shape(a) == shape(b) for a, b in zip(values, new, strict=True))
    check = lambda s: pii.luhn([int(c) for c in s[:-1]]) == int(s[-1])
    assert all(check(v) == check(makers.of("card", v)) for v in ["4111111111111111", "4111111111111112"])
    assert pii.iban_check("DE", "370400440532013000") == 89
    made = makers.of("iban", "DE89 3704 0044 0532 0130 00").replace(" ", "")
    assert pii.iban_check("DE", made[4:]) == int(made[2:4])
    small = [makers.sequence([a, b], 5, "t") for a in range(5) for b in range(5)]  # a whole small space
    assert sorted(small) == [[a, b] for a in range(5) for b in range(5)] and all(s != [k // 5, k % 5] for k, s in enumerate(small))
    assert makers.of("email", "ann@example.com") != pii.Surrogates(b"other").of("email", "ann@example.com")


def test_all_forms_of_an_entity_have_one_surrogate():
    makers = pii.Surrogates(b"key")
    for kind, forms in {
        "phone": ["+1 (017) 555-7713", "+1 017 555 7713", "+10175557713", "(017) 555-7713", "017-555-7713", "017.555.7713"],
        "card": ["4929348385146306", "4929 3483 8514 6306", "4929-3483-8514-6306"],
        "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
        "email": ["Ann.Lee@Example.com", "ann.lee@example.com", "ANN.LEE@EXAMPLE.COM"],
        "ipv6": ["2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:0db8::0001"],
        "name": ["Lopez", "LOPEZ"],
    }.items():
        assert len({pii.canonical(kind, f) for f in forms}) == 1
        assert len({pii.canonical(kind, makers.of(kind, f)) for f in forms}) == 1, kind
    texts = ["Mr Camille Dupont", "Camille Dupont", "Mr Ivan Lopez", "Mr Lopez", "Mrs DUPONT", "Dr. Anna-Maria Lopez"]
    new = [pii.replaced(t, makers)[0] for t in texts]
    assert new[0] == f"Mr {new[1]}" and new[2].split()[2] == new[3].split()[1] == new[5].split()[-1] and new[4].split()[1] == new[1].split()[1].upper()
    assert new[1].split()[0] in pii.GIVEN["latin", "u"]
    a, b = (pii.replaced(f"{t} Петров{e}", makers)[0].split()[1] for t, e in (("Господин", ""), ("Госпожа", "а")))
    assert b == a + "а" and a.endswith("ов") and a != "Петров"


def test_entities_and_coreference(docs):
    text = "Mrs Maria Lopez (maria.lopez@Example.com, +1 (017) 555-7713) and Mr. Иван Петров from 43.21.141.162 paid 4929348385146306; token = \"0f3b3c6a43eb78aa99cbd7049c572391524f37a8\" 123-45-6789 DE89 3704 0044 0532 0130 00"
    kinds = [k for _, _, k in pii.find(text)]
    assert kinds == ["name", "email", "phone", "name", "ip", "card", "secret", "ssn", "iban"]
    for clean in ("Version 2.0 of 1234 words, 3.14 and 2024-01-02.", "a@b", "10.5.3", "Chapter 12 (page 5) at 12:30:45", "", "std::vector and a::b", "The United Nations said no. New York is big."):
        assert [k for _, _, k in pii.find(clean) if k != "name"] == []
    rows = [(1, text), (2, "again maria.lopez@example.com"), (3, None), (4, ""), (5, "nothing here"), (5, "nothing here")]
    got = {r.doc_id: r for r in pii.report(docs(rows), b"key").collect()}
    assert got[1].n_entities == 9 and got[3].text is None and got[5].text == "nothing here" and got[4].text == ""
    new = got[2].text.split()[-1]
    assert new in got[1].text.lower() and "lopez" not in got[1].text.lower() and "555-7713" not in got[1].text
    assert re.search(r"Mrs (?:%s) " % "|".join(pii.GIVEN["latin", "f"]), got[1].text) and re.search(r"Mr\. (?:%s) [А-Я]" % "|".join(pii.GIVEN["cyrillic", "m"]), got[1].text)


# Written for this test: sentences, and the names in them.
NAMED = [
    ("My name is Kevin Smith.", ["Kevin Smith"]), ("Name: Priya Raman\nAge: 4", ["Priya Raman"]), ("Dear Kevin Smith,", ["Kevin Smith"]), ("Kind regards,\nBrenda O'Hara", ["Brenda O'Hara"]),
    ("Yesterday it rained, Kevin Smith said.", ["Kevin Smith"]), ("a letter that Tobias van der Berg wrote", ["Tobias van der Berg"]), ("write to Kevin Smith <kevin.smith@mail.com>", ["Kevin Smith"]),
    ("signed by Zoë Brontë", ["Zoë Brontë"]), ("Mr Kevin Smith and Mrs Smith", ["Kevin Smith", "Smith"]), ("Dr. Nguyen came", ["Nguyen"]), ("Thomas Miller left", ["Thomas Miller"]),
    ("I am called John F. Kennedy", ["John F. Kennedy"]), ("author: Grace Hopper", ["Grace Hopper"]), ("ich heiße Jürgen Klopp", ["Jürgen Klopp"]), ("Je m'appelle Brigitte Macron", ["Brigitte Macron"]),
    ("me llamo Pedro Sánchez", ["Pedro Sánchez"]), ("Меня зовут Лев Толстой", ["Лев Толстой"]), ("Frau Merkel kam", ["Merkel"]), ("Kevin Smith's house, says Dr Smith", ["Smith"]),
    ("We met Kevin Smith at noon.", ["Kevin Smith"]), ("contact: Aiko Tanaka, Tokyo", ["Aiko Tanaka"]), ("Regards,\nLars Ulrich\nUlrich is a drummer", ["Lars Ulrich", "Ulrich"]), ("Señor García López llegó", ["García López"]),
]


def test_recall_of_names():
    hit = want = found = 0
    for text, named in NAMED:
        got = [text[a:b] for a, b, k in pii.find(text) if k == "name"]
        want, found, hit = want + len(named), found + len(got), hit + sum((Counter(named) & Counter(got)).values())
    assert hit >= 0.9 * want and hit >= 0.9 * found, (hit, want, found)


def test_clean_prose_holds_no_names(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(k == "name" for t in texts if t for _, _, k in pii.find(t)) <= 0.01 * len(texts)


def test_detection_of_generated_entities():
    """Entities of all kinds and lengths put between words: each is found whole."""
    rnd = random.Random(6)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    low, digits, both = "abcdefghijkmnop", "0123456789", "abcXYZ012345678"
    for _ in range(300):
        kind, entity, around = rnd.choice([
            ("email", f"{draw(low, rnd.choice([1, 9, 90]))}.{draw(low, 3)}@{'.'.join(draw(low, rnd.choice([2, 80])) for _ in range(rnd.choice([1, 12])))}.com", "{}"),
            ("ip", ".".join(str(rnd.randrange(256)) for _ in range(4)), "from {},"), ("ipv6", ":".join(f"{rnd.randrange(1, 65536):x}" for _ in range(7)) + ":12", "at {} now"),
            ("secret", "a1" + draw("0123456789abcdef", rnd.choice([30, 62, 158, 900])), "key {}"), ("secret", draw(both, rnd.choice([12, 64, 360, 2000])), "api_key={} "),
            ("secret", "AKIA" + draw("ABCDEFGH2345", 16), "id {};"), ("phone", f"+1 ({draw(digits, 3)}) 555-{draw(digits, 4)}", "call {}!"), ("card", draw(digits, 16), "card {} "), ("ssn", f"{draw(digits, 3)}-{draw(digits, 2)}-{draw(digits, 4)}", "no {}."),
        ])
        text = f"some words {around.format(entity)} and more"
        assert [(text[a:b], k) for a, b, k in pii.find(text)] == [(entity, kind)], text


def test_collisions_stop_the_run(docs, spark, monkeypatch):
    made = pii.Surrogates.made
    df = docs([(1, "from 10.0.0.1 and 10.0.0.2"), (2, "to 10.0.0.3 10.0.0.1")])
    texts = [r.text for r in pii.replace_entities(df, b"key").collect()]
    assert len({x for t in texts for x in re.findall(r"[\d.]+", t)}) == 3
    row = "kind string, entity string, surrogate string"
    assert pii.collisions(spark.createDataFrame([("ip", "a", "x"), ("ip", "b", "y"), ("ip", "a", "x"), ("ssn", "a", "y")], row)) == 0
    assert pii.collisions(spark.createDataFrame([("ip", "a", "x"), ("ip", "b", "x")], row)) == 1 == pii.collisions(spark.createDataFrame([("ip", "a", "x"), ("ip", "a", "y")], row))
    monkeypatch.setattr(pii.Surrogates, "made", lambda self, kind, entity: "1.1.1.1" if kind == "ip" else made(self, kind, entity))
    with pytest.raises(ValueError, match="one to one"):
        pii.replace_entities(df, b"key")


def test_pii_keeps_columns(clashing, odd_rows, docs, spark):
    df = clashing(odd_rows)
    out = pii.replace_entities(df, b"key", length_col="n_chars")
    assert out.columns == df.columns and out.count() == len(odd_rows)
    assert pii.report(docs([]), b"key").count() == 0
    assert pii.session_key(spark) != pii.session_key(spark)
    spark.conf.set("spark.tessella.pii.key", "mine")
    assert pii.session_key(spark) == b"mine"
    spark.conf.unset("spark.tessella.pii.key")


def test_wrapped_notices_are_found(docs):
    notices = [(label, text) for label, text, _ in licenses.TEMPLATES if len(text.split()) >= 12]
    rows = []
    for k, (_, text) in enumerate(notices):
        words = text.split()
        rows.append((k, "# file header\n" + "\n".join("# " + " ".join(words[at : at + 5]) for at in range(0, len(words), 5))))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs(rows)).collect()}
    assert all(label in got[k] for k, (label, _) in enumerate(notices))


def test_entities_are_taken_whole():
    long, jwt = "aB3" * 400, "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJ-_x"
    found = {
        f"token={long} end": long, f"token: {jwt}.": jwt, "password: hunter2!x": "hunter2!x", "password = 'my pass phrase'": "my pass phrase", "client_secret=abcdefghijkl9": "abcdefghijkl9",
        "Dr. Anna Maria Schmidt came": "Anna Maria Schmidt", "call +442071234567 or": "+442071234567", "+4915112345678": "+4915112345678", "call 555 123 4567 now": "555 123 4567",
    }
    makers = pii.Surrogates(b"key")
    for text, entity in found.items():
        assert [text[a:b] for a, b, _ in pii.find(text)] == [entity]
    assert makers.of("phone", "+442071234567").startswith("+44") and makers.of("phone", "+4915112345678").startswith("+49")
    new = makers.of("secret", long)
    assert len(new) == len(long) and all(new[k : k + 20] != long[k : k + 20] for k in range(0, len(long), 20))
