"""BPE encoding and decoding by traversal of a trie of distinct words.

Words are split off as the vocabulary's file says (normalisation, pattern, byte alphabet, word-end
suffix). The distinct words that a slice brings anew are walked in sorted order with a stack, which
is the depth-first traversal of their trie: words that share a prefix share its states. The state
of a trie node is the last token of its prefix's encoding; with it the encoding is known, because any
front part of a BPE encoding is itself the encoding of what it spells. The last token at a
node is the one vocabulary token that ends there and may follow the last token at its own start,
where two tokens may stand side by side if merging their joined spelling gives just these two.

Encodings of words, and of whole space-free stretches, are kept per worker process in tables of bounded
size that are emptied when full; nothing is dropped from the results.

Characters that this Python's Unicode tables do not know yet are rare; a stretch that has one is split by
the library itself, whose tables decide what is a letter.

Added tokens (control strings) in a text are matched as the tokenizers library does, longest first
on a tie of places. Decoding joins the tokens' spellings by one space, as that library does for a vocabulary
without a decoder.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows give a row each; a very
long text is encoded whole, one at a time; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rowwise, texts

KEEP = 500_000
LONG = 96


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Lengths(dict):
    """By the last four bytes (fewer at a word's start): the lengths of tokens that may end there, longest first."""

    def __init__(self, table: dict[bytes, int]):
        self.table = table
        self.longer: dict[bytes, set[int]] = {}
        for token in table:
            if len(token) > 4:
                self.longer.setdefault(token[-4:], set()).add(len(token))

    def __missing__(self, tail: bytes) -> list[int]:
        if len(self) > KEEP:
            self.clear()
        found = sorted(self.longer.get(tail, ()), reverse=True) + [n for n in range(len(tail), 0, -1) if tail[-n:] in self.table]
        self[tail] = found
        return found


class Bpe:
    """Encoder for a tokenizers file with word-end suffix and no decoder."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.simple = self.split("ab.") == ["ab", "."] and self.split("ab") == ["ab"]
        self.assigned: set[str] = set()
        self.names = {i: t for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(sorted(map(regex.escape, self.added), key=len, reverse=True)) + ")").split if self.added else None
        self.special_bytes = [t.encode() for t in self.added]

        back = {c: bytes([b]) for b, c in enumerate(self.letters)}
        self.spell = spell = lambda t: b"".join(back[c] for c in t)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.spelling: dict[int, tuple[bytes, bool]] = {}
        for t, i in model["vocab"].items():
            ends = t.endswith(self.end) and len(t) > len(self.end)
            raw = spell(t.removesuffix(self.end) if ends else t)
            (self.final if ends else self.inner)[raw] = i
            self.spelling[i] = (raw, ends)
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        vocab = model["vocab"]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner_sizes, self.final_sizes = Lengths(self.inner), Lengths(self.final)
        self.beside: dict[int, bool] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.late: dict[bytes, tuple[bytes, bytes]] = {}
        self.early: dict[bytes, tuple[bytes, bytes]] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging: the pair of lowest rank first, the leftmost on a tie."""
        get = self.merge.get
        while len(ids) > 1:
            rank, at, new = 1 << 60, -1, 0
            for k in range(len(ids) - 1):
                if (m := get((ids[k], ids[k + 1]))) is not None and m[0] < rank:
                    (rank, new), at = m, k
            if at < 0:
                return ids
            ids[at : at + 2] = [new]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 4 * KEEP:
                self.beside.clear()
            x, (y, ends) = self.spelling[a][0], self.spelling[b]
            ids = [self.inner[bytes([c])] for c in x + y]
            if ends:
                ids[-1] = self.final[y[-1:]]
            known = self.beside[key] = self.merged(ids) == [a, b]
        return known

    def last_token(self, word: bytes, depth: int, states: list[int], table: dict[bytes, int], lengths: Lengths) -> int:
        for size in lengths[word[max(0, depth - 4) : depth]]:
            token = table.get(word[depth - size : depth]) if size <= depth else None
            if token is not None and (size == depth or self.may_follow(states[depth - size], token)):
                return token
        raise ValueError(f"no token ends at byte {depth} of {word[:80]!r}")

    def traverse(self, words: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Depth-first over the trie of words. states[d]: last token of the first d bytes, not at a word's end."""
        out: dict[bytes, tuple[int, ...]] = {}
        states: list[int] = [-1]
        before = b""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word[:-1], before, strict=False):
                if a != b:
                    break
                shared += 1
            del states[min(shared, len(word) - 1) + 1 :]
            for depth in range(len(states), len(word)):
                states.append(self.last_token(word, depth, states, self.inner, self.inner_sizes))
            ids = [self.last_token(word, len(word), states, self.final, self.final_sizes)]
            at = len(word) - len(self.spelling[ids[0]][0])
            while at:
                ids.append(states[at])
                at -= len(self.spelling[states[at]][0])
            out[word] = tuple(reversed(ids))
            before = word[:-1]
        return out

    def unknown(self, text: str) -> bool:
        new = set(text) - self.assigned
        bad = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - bad
        return bool(bad)

    def pieces(self, raw: bytes) -> list[bytes]:
        """The words of a space-free stretch without added tokens."""
        if self.simple and raw[:-1].isalpha():  # letters of ASCII and one more character at most
            if raw.isalpha():
                return [raw.lower()]
            if raw[-1:] in (b".", b","):
                return [raw[:-1].lower(), raw[-1:]]
        text = raw.decode("utf-8", "replace")
        if not text.isascii():
            if self.unknown(text):
                text = self.library.normalizer.normalize_str(text)
                return [self.spell(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma
        return [w.encode() for w in self.split(text)]

    def encoded(self, stretches: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Of each space-free stretch: the ids' bytes, and the tokens' spellings joined by a space."""
        parts: dict[bytes, list] = {}
        for s in stretches:
            if self.special_bytes and b"<" in s and any(x in s for x in self.special_bytes):
                text = self.specials(s.decode("utf-8", "replace"))
                parts[s] = [w for x in text if x for w in ([self.added[x]] if x in self.added else self.pieces(x.encode()))]
            else:
                parts[s] = self.pieces(s)
        found = self.traverse({w for p in parts.values() for w in p if not isinstance(w, int)} - self.words.keys())
        if len(self.words) > KEEP:
            self.words.clear()
        words = self.words
        words.update((w, i) for w, i in found.items() if len(w) <= LONG)
        out = {}
        names = self.names
        for s, p in parts.items():
            ids: list[int] = []
            for w in p:
                if isinstance(w, int):
                    ids.append(w)
                else:
                    ids += words.get(w) or found.get(w) or self.traverse({w})[w]
            out[s] = struct.pack(f"<{len(ids)}I", *ids), " ".join([names[i] for i in ids]).encode()
        return out

    def texts(self, bodies: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Number of ids, ids as little-endian 32-bit integers, and decoded text, of each text.

        Two tables, the stretches of late and those before: what is met again moves over, so that common ones stay when a full table goes.
        """
        split = [b.split() for b in bodies]
        if len(self.late) > KEEP // 2:
            self.early, self.late = self.late, {}
        late, early = self.late, self.early
        wanted = {s for x in split for s in x} - late.keys()
        again = wanted & early.keys()
        late.update((s, early[s]) for s in again)
        found = self.encoded(wanted - again)
        long = {s: v for s, v in found.items() if len(s) > LONG}
        late.update((s, v) for s, v in found.items() if len(s) <= LONG)
        out = []
        for x in split:
            got = [late[s] for s in x] if not long else [late.get(s) or long[s] for s in x]
            ids = b"".join([g[0] for g in got])
            out.append((len(ids) // 4, ids, b" ".join([g[1] for g in got if g[1]])))
        return out


def coder(path: str) -> Bpe:
    """This worker process's encoder for the file; it outlives a task."""
    state = sys.modules.setdefault("_tessella_worker", types.ModuleType("_tessella_worker"))
    made = state.__dict__.setdefault("bpe", {})
    if path not in made:
        made[path] = Bpe(path)
    return made[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """n_tokens and the digests of ids and decoded text of every row; with outputs, ids and decoded text too."""
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    names = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if outputs:
        fields, names = [*fields, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())], f"{names}, ids array<int>, decoded string"

    def kernel(ids, bodies):
        for i, (n, raw, decoded) in zip(ids, coder(path).texts(bodies), strict=True):
            row = i, n, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()
            yield (*row, np.frombuffer(raw, "<u4").tolist(), decoded.decode()) if outputs else row

    return texts(df, id_col, text_col).mapInArrow(rowwise(kernel, pa.schema(fields), 4 << 20), names)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
