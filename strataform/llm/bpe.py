"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid out in one symbol array. An index maps every mergeable
adjacent pair, by its rank, to all its positions in that array. The active ranks are taken in
ascending order: all occurrences of the pair are merged at once, the pairs left and right of
each merged symbol are entered under their own ranks, and stale positions are dropped when
their rank comes up. A merge can only create pairs that contain the new symbol; `MergeTable`
checks that those all rank higher, which makes this equal to merging each word by itself.

Defined results
    null or empty text: no tokens (`ids` empty, `decoded` empty string).
    text with only white space: no tokens.
    repeated rows and ties: equal texts give equal values, rows are independent.
    empty table: empty result with the same schema.
    other columns are kept by `encode` unless an output column has the same name, in which case
    the output column replaces it.

Everything is a map over rows: no shuffle, memory bounded by one Arrow batch plus a word cache
of `cache_words` entries for each task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.names import unused
from strataform.session import lean, ship_package

#: Words of a partition that are kept with their encodings before it starts afresh.
CACHE_WORDS = 60_000
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class MergeTable:
    """Ranked merges as sorted arrays: (left, right) -> rank, and rank -> (left, right, result)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.n_ids = max(vocab.values(), default=0) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.n_ids + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        first = np.full(self.n_ids, len(merges), np.int64)
        np.minimum.at(first, left, np.arange(len(merges)))
        np.minimum.at(first, right, np.arange(len(merges)))
        #: Every merge makes symbols that only later merges use.
        self.monotone = bool(np.all(first[self.made] > np.arange(len(merges)))) if merges else True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left.astype(np.int64) * self.n_ids + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)


class PairIndex:
    """Positions of every mergeable pair, by rank, in a symbol array of many words."""

    def __init__(self, table: MergeTable):
        self.table, self.at, self.active = table, {}, []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks != _NONE
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist(), len(ranks)]
        for a, b in zip(starts, starts[1:], strict=False):
            rank = int(ranks[a])
            if rank in self.at:
                self.at[rank].append(positions[a:b])
            else:
                self.at[rank] = [positions[a:b]]
                heapq.heappush(self.active, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        lists = self.at.pop(rank)
        return rank, lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))


def merge_words(table: MergeTable, symbols: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges to words laid end to end; returns the remaining symbols and their words."""
    n = len(symbols)
    if not n:
        return symbols, word_of
    if not table.monotone:
        raise ValueError("the merge list uses a symbol before it makes it")
    sym = symbols.astype(np.int32)
    # one spare slot at the end stands for "no neighbour"
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = np.r_[word_of[1:] != word_of[:-1], True]
    nxt[last], prv[np.r_[True, last[:-1]]] = n, n
    sym, nxt, prv = (np.append(x, np.int32(y)) for x, y in ((sym, -1), (nxt, n), (prv, n)))
    alive = np.ones(n + 1, bool)
    index = PairIndex(table)
    inner = np.flatnonzero(~last).astype(np.int32)
    index.add(table.ranks(sym[inner], sym[inner + 1]), inner)
    while index.active:
        rank, pos = index.pop()
        a, b = table.left[rank], table.right[rank]
        right = nxt[pos]
        ok = alive[pos] & (sym[pos] == a) & (sym[right] == b)
        pos, right = pos[ok], right[ok]
        if not len(pos):
            continue
        if a == b:  # in a run such as a a a only every second position starts a pair
            chained = np.r_[False, right[:-1] == pos[1:]]
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
            keep = (np.arange(len(pos)) - start) % 2 == 0
            pos, right = pos[keep], right[keep]
        sym[pos], alive[right] = table.made[rank], False
        after = nxt[right]
        nxt[pos], prv[after] = after, pos
        before = prv[pos]
        has = after != n
        index.add(table.ranks(sym[pos[has]], sym[after[has]]), pos[has])
        has = before != n
        index.add(table.ranks(sym[before[has]], sym[pos[has]]), before[has])
    left = np.flatnonzero(alive[:n])
    return sym[left], word_of[left]


class _Codes(dict):
    """Gives each new word the next free number."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


class WordBpe:
    """A tokenizer of the word-end kind read from a tokenizers JSON file.

    Steps: literal special strings are cut out first; the rest is NFC-normalised and lower-cased
    character by character, split by the file's pattern (white space falls away), turned into
    byte symbols, and merged.
    """

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        doc = json.loads(spec)
        model = doc["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        alphabet, end = byte_alphabet(), model.get("end_of_word_suffix") or ""
        self.inner = np.array([self.vocab[c] for c in alphabet], np.int32)
        self.final = np.array([self.vocab[c + end] for c in alphabet], np.int32)
        split = next(p for p in doc["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.spec, self.library, self.cache_words = spec, None, cache_words
        self.settled: set[str] = set()
        self._reset()

    def _reset(self) -> None:
        self.codes, self.id_text, self.token_text, self.counts = _Codes(), [], [], []
        for s, i in self.special.items():  # kept under a key that no piece can equal, as pieces have no white space
            self.codes[f" {s}"]
            self.id_text.append(str(i)), self.token_text.append(s), self.counts.append(1)

    def _unsettled(self, text: str) -> bool:
        """Whether a code point has no class in this Python's Unicode version.

        Libraries of other versions may class it; only the tokenizers library's own splitter
        is sure to agree with itself there.
        """
        new = set(text) - self.settled
        free = {c for c in new if unicodedata.category(c) == "Cn"}
        self.settled |= new - free
        return bool(free)

    def _library_split(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self.library is None:
            self.library, self.byte_of = Tokenizer.from_str(self.spec), {c: b for b, c in enumerate(byte_alphabet())}
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, s)).decode("utf-8") for s, _ in shown]

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if not self.settled.issuperset(text) and self._unsettled(text):
                return self._library_split(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pieces(text.lower())

    def words(self, text: str | None) -> array:
        """The text's words as numbers of the current cache."""
        if not text:
            return array("i")
        if self.cut is None or "<|" not in text and not any(s in text for s in self.special):
            return array("i", map(self.codes.__getitem__, self._split(text)))
        out = array("i")
        for part in self.cut(text):
            if part in self.special:
                out.append(self.codes[f" {part}"])
            else:
                out.extend(map(self.codes.__getitem__, self._split(part)))
        return out

    def _encode_new(self) -> None:
        words = list(self.codes)[len(self.id_text) :]
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.final[flat[ends]]
        ids, word_of = merge_words(self.table, symbols, np.repeat(np.arange(len(words), dtype=np.int32), size))
        cuts = np.searchsorted(word_of, np.arange(len(words) + 1)).tolist()
        ids = ids.tolist()
        shown = [str(i) for i in ids]
        tokens = [self.strings[i] for i in ids]
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.id_text.append(" ".join(shown[a:b]))
            self.token_text.append(" ".join(tokens[a:b]))
            self.counts.append(b - a)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: token count, ids joined by a space, and the decoded text."""
        if len(self.codes) > self.cache_words:
            self._reset()
        coded = [self.words(t) for t in texts]
        self._encode_new()
        ids, tokens, counts = self.id_text.__getitem__, self.token_text.__getitem__, self.counts.__getitem__
        return [(sum(map(counts, c)), " ".join(map(ids, c)), " ".join(map(tokens, c))) for c in coded]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_batch([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space, specials included; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_LOADED: dict[tuple[str, int], WordBpe] = {}


def loaded(spec: str, cache_words: int = CACHE_WORDS) -> WordBpe:
    """One tokenizer, with its word cache, for each Python worker and file."""
    key = (hashlib.sha256(spec.encode()).hexdigest(), cache_words)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(spec, cache_words)
    return _LOADED[key]


def _chunks(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _with_columns(df: DataFrame, text_col: str, fields: list[pa.Field], make) -> DataFrame:
    """`df` with the columns that make(texts) returns; columns of those names are replaced."""
    ship_package(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    add_text = text_col not in kept
    text = unused(kept, "text_read") if add_text else text_col
    source = df.select(*(F.col(f"`{c}`") for c in kept), *([F.col(f"`{text_col}`").alias(text)] if add_text else []))
    out = df.select(*(F.col(f"`{c}`") for c in kept))
    from pyspark.sql.pandas.types import from_arrow_type

    for f in fields:
        out = out.withColumn(f.name, F.lit(None).cast(from_arrow_type(f.type)))

    def run(batches):
        try:
            for batch in batches:
                texts = batch.column(text).to_pylist()
                for a, b in _chunks(texts):
                    part = batch.slice(a, b - a)
                    made = make(texts[a:b])
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(m, f.type) for m, f in zip(made, fields, strict=True))], [*kept, *names])
        finally:
            for bpe in _LOADED.values():  # the tables stay with the worker, a partition's words do not
                bpe._reset()

    return source.mapInArrow(lean(run), out.schema)


def encode(df: DataFrame, spec: str, text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Adds `ids` (array of long) and `decoded` (string) to every row; `spec` is the tokenizer file's content."""
    fields = [pa.field("ids", pa.list_(pa.int64())), pa.field("decoded", pa.string())]

    def make(texts):
        rows = loaded(spec, cache_words).encode_batch(texts)
        return [np.fromstring(i, np.int64, sep=" ") if i else np.empty(0, np.int64) for _, i, _ in rows], [d for _, _, d in rows]

    return _with_columns(df, text_col, fields, make)


def decode(df: DataFrame, spec: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`: the token strings of `ids_col` joined by a space; null ids give an empty string."""
    fields = [pa.field("decoded", pa.string())]

    def make(ids):
        bpe = loaded(spec)
        return [[bpe.decode(x or []) for x in ids]]

    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c != "decoded"]
    schema = df.select(*(F.col(f"`{c}`") for c in kept)).withColumn("decoded", F.lit("")).schema

    def run(batches):
        for batch in batches:
            made = make(batch.column(ids_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made[0], pa.string())], [*kept, fields[0].name])

    return df.mapInArrow(lean(run), schema)


def digests(df: DataFrame, spec: str, text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of encode-then-decode, without shipping the ids themselves."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def make(texts):
        rows = loaded(spec, cache_words).encode_batch(texts)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return [n for n, _, _ in rows], [sha(i) for _, i, _ in rows], [sha(d) for _, _, d in rows]

    return _with_columns(df, text_col, fields, make)
