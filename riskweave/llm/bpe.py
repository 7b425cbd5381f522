"""BPE encoding and decoding by a token automaton.

The merges of a vocabulary are compiled into a deterministic automaton whose arcs are labelled with tokens. It starts as
one state that loops on every base symbol. Each merge (u, v) -> t is one gadget: the state that u leads to is copied
without its v arc, and every state with a u arc gets a t arc to where v led. What a state allows depends on the label of
the arc that enters it only, so states are named by tokens and the automaton is kept as three tables in merge order: the
cut arcs, and each token's birth with its left and right part. A sequence of tokens is the BPE encoding of its text if and
only if it is a path of that automaton, and each text has exactly one.

A word is encoded by table-driven transitions: from the state reached, the longest arc that spells what comes next, going
back where no arc leads on. The path that spells the whole word is the only one. Decoding emits the path's arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White_Space of Unicode, for a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Most words whose encoding a worker keeps in each of two generations; the older one goes when the younger is full.
CACHE_WORDS = 100_000


def plain_pattern() -> tuple[re.Pattern, re.Pattern]:
    """The usual split pattern for re, which is faster, and the characters whose classes differ there: numbers that aren't
    decimal digits, controls that only re takes for white space, what this Python's tables don't know, and all beyond the
    first plane."""
    strange = lambda x: x.isalnum() and not x.isalpha() and not x.isdecimal() or unicodedata.category(x) == "Cn"
    odd = [chr(c) for c in range(0x10000) if strange(chr(c))]
    return re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"), re.compile("[\x1c-\x1f" + "".join(odd) + "\U00010000-\U0010ffff]")


#: The pattern that plain_pattern stands for.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class MergeAutomaton:
    """Deterministic automaton over tokens, built from merges in order.

    `allows(q, t)`: is there an arc t in the state that q leads to. `encode(symbols)`: token ids of a list of base symbols.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.cut: dict[tuple[int, int], int] = {}
        size = max(vocab.values(), default=-1) + 1
        self.birth, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.known: dict[int, bool] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.tokens = {s: t for s, t in vocab.items()}
        self.longest = max(map(len, vocab), default=1)
        self.lengths = self._lengths()

    def _lengths(self) -> dict[str, tuple[int, ...]]:
        """Of each first three symbols, the lengths of arcs that can spell what begins so, descending."""
        sizes: dict[str, set[int]] = {}
        for s in self.vocab:
            if len(s) > 2:
                sizes.setdefault(s[:3], {1, 2}).add(len(s))
        return {head: tuple(sorted(x, reverse=True)) for head, x in sizes.items()}

    def _gadget(self, rank: int, u: int, v: int, t: int) -> None:
        if (u, v) in self.cut or self.birth[t] >= 0 or not self._arc(u, v, rank):
            return  # a merge that can never apply adds no arc
        self.cut[u, v] = rank
        self.birth[t], self.left[t], self.right[t] = rank, u, v

    def _arc(self, q: int, t: int, before: int) -> bool:
        """Is arc t in the state of q once the gadgets below rank `before` are in: follow the copies back to base symbols."""
        cut, birth = self.cut, self.birth
        while True:
            if cut.get((q, t), before) < before:
                return False
            bq, bt = birth[q], birth[t]
            if bq < 0 and bt < 0:
                return True
            if bt >= bq:  # the gadget cuts before it adds: (u, u) -> t leaves u no t arc
                t, before = self.left[t], bt + 1
            else:
                q, before = self.right[q], bq

    def allows(self, q: int, t: int) -> bool:
        key = q << 32 | t
        hit = self.known.get(key)
        if hit is None:
            if len(self.known) > 500_000:
                self.known.clear()
            hit = self.known[key] = self._arc(q, t, 1 << 40)
        return hit

    def encode(self, word: str, end: str = "") -> list[int]:
        """word: one character for each symbol; end: suffix that the last symbol carries."""
        n, tokens, known, lengths = len(word), self.tokens, self.known, self.lengths
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()  # positions from which no path goes on; a prefix has one path, so none is tried twice
        j, most = 0, n
        while j < n:
            last = out[-1] if out else -1
            rest, step = n - j, 0
            if rest <= most and rest <= self.longest:
                t = tokens.get(word[j:] + end)
                if t is not None and (last < 0 or (known[key] if (key := last << 32 | t) in known else self.allows(last, t))):
                    step = rest
            if not step:
                for size in lengths.get(word[j : j + 3], (2, 1)):
                    if size < rest and size <= most and j + size not in dead:
                        t = tokens.get(word[j : j + size])
                        if t is not None and (last < 0 or (known[key] if (key := last << 32 | t) in known else self.allows(last, t))):
                            step = size
                            break
            if step:
                out.append(t)
                starts.append(j)
                j, most = j + step, n
            else:
                if not out:
                    raise ValueError("no path: a symbol is missing from the vocabulary")
                dead.add(j)
                out.pop()
                most = j - starts[-1] - 1
                j = starts.pop()
        return out


class WordBpe:
    """Encoder and decoder of a lower-casing vocabulary with word ends, from a tokenizer file in JSON."""

    def __init__(self, spec: dict):
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", "[^" + SPACE))
        self.plain, self.odd = plain_pattern() if pattern == USUAL else (None, None)
        self.rare = plain_pattern()[1] if self.odd is None else self.odd
        self.library, self.spec = None, json.dumps(spec)
        self.shown = {i: str(i) for i in self.label}
        self.bytes = dict(enumerate(byte_symbols()))
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def normalize(self, text: str) -> str:
        """NFC, lower case for each character by itself; runs of white space need no change, words never cross them."""
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        return self.automaton.encode(word.encode().decode("latin-1").translate(self.bytes), self.end)

    def entry(self, word: str) -> tuple[str, int, str]:
        """Ids as text, their number, and the arc labels that decode them, of one pre-split word."""
        out = self.cache.get(word) or self.older.get(word)  # in a long text the caller may hold a generation that is gone
        if out is None:
            ids = self.word(word)
            out = (" ".join([self.shown[i] for i in ids]), len(ids), " ".join([self.label[i] for i in ids]))
        if len(self.cache) >= CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        if len(word) <= 100:
            self.cache[word] = out
        return out

    def forget(self) -> None:
        """Drop the cached words and arcs; workers live on after a task."""
        self.cache, self.older = {}, {}
        self.automaton.known.clear()

    def _unknown(self, text: str, out: list) -> None:
        """Words of a text with characters that aren't in this Python's Unicode tables, split by the tokenizer library, whose
        tables may be older or newer."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            ids = self.automaton.encode(symbols, self.end)
            out.append((" ".join([self.shown[i] for i in ids]), len(ids), " ".join([self.label[i] for i in ids])))

    def _piece(self, text: str, out: list) -> None:
        if not text.isascii() and self.rare.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            self._unknown(text, out)
            return
        get, entry = self.cache.get, self.entry
        text = self.normalize(text)
        words = self.plain if self.plain and not self.odd.search(text) else self.words
        out.extend([get(w) or entry(w) for w in words.findall(text)])

    def encode_text(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by a space, number of ids, decoded text). Null counts as empty."""
        out: list[tuple[str, int, str]] = []
        text = text or ""
        if self.cut_special is None or "<|" not in text:
            self._piece(text, out)
        else:
            at = 0
            for m in self.cut_special.finditer(text):
                self._piece(text[at : m.start()], out)
                out.append((str(self.special[m[0]]), 1, m[0]))
                at = m.end()
            self._piece(text[at:], out)
        return " ".join([x[0] for x in out]), sum([x[1] for x in out]), " ".join([x[2] for x in out])

    def decode(self, ids: list[int]) -> str:
        """Labels of the path's arcs, joined by a space: this vocabulary file has no decoder."""
        return " ".join(self.label[i] for i in ids)


@lru_cache(maxsize=2)
def _load(spec_json: str) -> WordBpe:
    return WordBpe(json.loads(spec_json))


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text of `docs` and decode the ids again.

    vocabulary: content (JSON text) of the tokenizer file; its size is fixed by the vocabulary, not the data.
    Returns one row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids array<int>.
    Null or empty texts have no tokens and the digests of the empty string; a null id stays null; other columns are
    ignored, whatever their names; repeated rows give repeated results; an empty table gives an empty one.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids_sha, text_sha, ids = [], [], [], []
                for value in part.column(1):
                    found, count, decoded = bpe.encode_text(value.as_py())
                    n.append(count)
                    ids_sha.append(hashlib.sha256(found.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        ids.append([int(x) for x in found.split(" ")] if found else [])
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
