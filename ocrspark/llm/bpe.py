"""BPE encoding and decoding with a public vocabulary file.

A word's symbols are merged by a segment tree over its adjacent pairs: every leaf holds the rank
of a pair, the root the least rank and the leftmost place that has it, and a merge changes a few
leaves whose paths are brought up to date in logarithmic time, until no pair can be merged. So a
word without blanks as long as a text costs n log n.

The file's rules are those of a byte-level vocabulary with word ends: composed characters, one
blank for white space, lower case, words cut by a pattern, bytes written as printable characters.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from ocrspark.llm.common import session, slices, widened

#: The pattern that cuts words, and white space between them.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Composition and lower case as the library has them, whose Unicode version is not that of Python.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
#: Characters that Python takes for white space and the vocabulary's rules do not.
CONTROLS = re.compile("[\x1c-\x1f]")
WORD_END = "</w>"
#: Entries of the word caches of a task; a full cache starts anew.
CACHED = 400_000
#: Bytes of a word up to which words are merged together.
BATCHED = 32
#: Bits of a place and of a symbol; rank of a pair that cannot be merged, and the least leaf of it.
PLACE, SHIFT = 32, 24
MASK = (1 << PLACE) - 1
NEVER_RANK = 1 << 28
NEVER = NEVER_RANK << PLACE


def _class(inside: np.ndarray) -> str:
    """Runs of code points as the inside of a character class."""
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


@lru_cache(maxsize=1)
def library_words() -> tuple[re.Pattern, regex.Pattern]:
    """Characters that the library classes unlike ``WORDS``, and the pattern of words for texts with them.

    Which code points are letters or numbers depends on the Unicode version, and the library and the
    module ``regex`` follow different ones. So the library is asked once in each process, with one
    string of the planes 0 to 3, as no version has letters or numbers in others, and texts without such a
    character keep to ``WORDS``.
    """
    points = np.r_[0:0xD800, 0xE000:0x40000]
    text = "".join(map(chr, points.tolist()))
    runs, odd = {}, np.zeros(0x40000, bool)
    for kind in ("L", "N"):
        split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
        theirs, ours = np.zeros((2, 0x40000), bool)
        for _, (a, b) in split.pre_tokenize_str(text):
            theirs[points[a:b]] = True
        for m in regex.finditer(rf"\p{{{kind}}}+", text):
            ours[points[m.start() : m.end()]] = True
        runs[kind] = _class(theirs)
        odd |= theirs != ours
    exact = WORDS.pattern.replace(r"\p{L}", runs["L"]).replace(r"\p{N}", runs["N"])
    return re.compile(f"[{_class(odd)}]" if odd.any() else "(?!)"), regex.compile(exact)


def byte_letters() -> list[str]:
    """A printable character for every byte: printable Latin-1 stands for itself, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


def merged(symbols: list[int], ranks: dict[int, int], results: list[int]) -> list[int]:
    """Symbols after all merges, least rank first and leftmost among equals.

    ``ranks`` gives the rank of a pair packed into one integer, ``results`` the symbol a rank makes.
    A leaf of the tree packs the rank of the pair that starts at its place with the place, so the
    lesser of two nodes is also the left one of equals, and the root names the next merge.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of = ranks.get
    size = 1 << (n - 2).bit_length()
    tree = [NEVER] * (2 * size)
    k = size
    for a, b in zip(symbols, symbols[1:]):
        tree[k] = rank_of(a << SHIFT | b, NEVER_RANK) << PLACE | (k - size)
        k += 1
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    symbols = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    while (top := tree[1]) < NEVER:
        at = top & MASK
        gone = after[at]
        symbol = symbols[at] = results[top >> PLACE]
        symbols[gone] = -1
        after[at] = last = after[gone]
        leaves = []
        if last < n:
            before[last] = at
            leaves.append((gone, NEVER))
            leaves.append((at, rank_of(symbol << SHIFT | symbols[last], NEVER_RANK) << PLACE | at))
        else:
            leaves.append((at, NEVER))
        left = before[at]
        if left >= 0:
            leaves.append((left, rank_of(symbols[left] << SHIFT | symbol, NEVER_RANK) << PLACE | left))
        for place, value in leaves:
            k = size + place
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    return [s for s in symbols if s >= 0]


class Merger:
    """The same trees for many short words at a time, a row of arrays per word."""

    def __init__(self, ranks: dict[int, int], results: list[int]):
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.ranks = np.r_[np.fromiter(ranks.values(), np.int64, len(ranks))[order], NEVER_RANK]
        self.results = np.array(results or [0], np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        pairs = left << SHIFT | right
        at = np.searchsorted(self.keys, pairs)
        rank = np.where((self.keys[at] == pairs) & (left >= 0) & (right >= 0), self.ranks[at], NEVER_RANK)
        return rank << PLACE | place

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols filled up with -1 at the end, after all merges with -1 for those merged away."""
        n, width = symbols.shape
        size = 1 << max(0, (width - 2)).bit_length()
        # one column more on either side, so that the neighbours of the first and last symbol are none
        row = np.full((n, size + 2), -1, np.int64)
        row[:, 1 : width + 1] = symbols
        sizes = (symbols >= 0).sum(axis=1)
        after = np.tile(np.arange(1, size + 3), (n, 1))
        before = np.tile(np.arange(-1, size + 1), (n, 1))
        tree = np.full((n, 2 * size), NEVER, np.int64)
        tree[:, size:] = self.leaf(row[:, 1 : size + 1], row[:, 2:], np.arange(size)[None, :])
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            top = tree[live, 1]
            at = (top & MASK) + 1
            gone = after[live, at]
            last = after[live, gone]
            left = before[live, at]
            made = self.results[top >> PLACE]
            row[live, at] = made
            row[live, gone] = -1
            after[live, at] = last
            inside = last <= sizes[live]
            before[live[inside], last[inside]] = at[inside]
            next_ = np.where(inside, row[live, np.minimum(last, size + 1)], -1)
            for place, value in (
                (gone, np.full(len(live), NEVER)), (at, self.leaf(made, next_, at - 1)),
                (left, self.leaf(row[live, left], made, left - 1)),
            ):
                ok = (place >= 1) & (place <= size)
                rows, k = live[ok], size + place[ok] - 1
                tree[rows, k] = value[ok]
                for _ in range(size.bit_length() - 1):
                    k = k >> 1
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            live = live[tree[live, 1] < NEVER]
        return row[:, 1 : width + 1]


class Tokenizer:
    """The vocabulary of a file with its merges by pair of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.vocab = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = {i: p for p, i in vocab.items()} | {i: p for p, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.pieces}
        self.ranks, self.results = {}, []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[vocab[a] << SHIFT | vocab[b]] = rank
            self.results.append(vocab[a + b])
        self.letters = byte_letters()
        self.starts = np.array([vocab.get(x, -1) for x in self.letters], np.int64)
        self.ends = np.array([vocab.get(x + WORD_END, -1) for x in self.letters], np.int64)
        self.merger = Merger(self.ranks, self.results)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks = _Chunks(self)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern."""
        ids = self.words.get(word)
        if ids is None:
            letters = [self.letters[b] for b in word.encode()]
            letters[-1] += WORD_END
            # a symbol that the vocabulary lacks leaves no id behind, as there is no unknown token
            ids = tuple(merged([self.vocab[x] for x in letters if x in self.vocab], self.ranks, self.results))
            if len(word) < 100:
                if len(self.words) >= CACHED:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def cut(self, chunk: str) -> list[str]:
        """Words of the pattern in a stretch without white space."""
        if chunk.isascii():
            return WORDS.findall(chunk.lower())
        odd, exact = library_words()
        plain = NORMAL.normalize_str(chunk)
        return (exact if odd.search(plain) else WORDS).findall(plain)

    def prepare(self, texts: list[str | None]) -> None:
        """Put the short words of the texts into the caches, all at once."""
        met = set().union(*(self.stretches(t or "") for t in texts)) - self.chunks.keys()
        if len(self.chunks) + len(met) > CACHED:
            self.chunks.clear()
        if (self.starts < 0).any() or (self.ends < 0).any():
            return
        cut = {c: self.cut(c) for c in met if len(c) < 100}
        words = {w for ws in cut.values() for w in ws if w not in self.words}
        if len(self.words) + len(words) > CACHED:
            self.words.clear()
            words = {w for ws in cut.values() for w in ws}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            if len(raw) <= BATCHED:
                by_size.setdefault((len(raw) + 7) // 8, []).append((w, raw))
        for eights, group in by_size.items():
            sizes = np.array([len(raw) for _, raw in group])
            flat = np.frombuffer(b"".join(raw for _, raw in group), np.uint8)
            inside = np.arange(8 * eights + 1)[None, :] < sizes[:, None]
            symbols = np.full(inside.shape, -1, np.int64)
            symbols[inside] = self.starts[flat]
            symbols[np.arange(len(group)), sizes - 1] = self.ends[flat[np.cumsum(sizes) - 1]]
            done = self.merger.merged(symbols)
            left = done >= 0
            ends = np.cumsum(left.sum(axis=1)).tolist()
            ids, start = done[left].tolist(), 0
            for (w, _), end in zip(group, ends):
                self.words[w] = tuple(ids[start:end])
                start = end
        for c, ws in cut.items():
            self.chunks[c] = self.word(ws[0]) if len(ws) == 1 else tuple(chain.from_iterable(map(self.word, ws)))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch without white space."""
        words = self.cut(chunk)
        return self.word(words[0]) if len(words) == 1 else tuple(chain.from_iterable(map(self.word, words)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a null or empty one. Special tokens in a text are recognised."""
        text = text or ""
        if self.split_special and "<|" in text:
            out: list[int] = []
            for part in self.split_special.split(text):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, self.stretches(text))))

    @staticmethod
    def stretches(text: str) -> list[str]:
        return SPACE.split(text) if CONTROLS.search(text) else text.split()

    def decode(self, ids: list[int]) -> str:
        """Pieces of the ids joined by blanks, special tokens included, as the file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids))


class _Chunks(dict):
    """Ids of the stretches met lately."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.tokenizer.chunk(chunk)
        if len(chunk) < 100:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker process and file."""
    return Tokenizer(path)


def _shipped(df: DataFrame, path: str) -> str:
    """Name under which every executor has the vocabulary file."""
    sc = session(df.sparkSession).sparkContext
    name = os.path.basename(path)
    if not any(f.endswith(f"/{name}") for f in sc.listFiles):
        sc.addFile(path)
    return name


def _encoded(batches, name: str, at: int, fields):
    bpe = tokenizer(SparkFiles.get(name))
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at], 1 << 20):
            texts = batch.column(at).to_pylist()
            bpe.prepare(texts)
            ids = pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], fields)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text as an array of integers.

    Null and empty texts have an empty array; other columns pass through, a column of the name of the
    ids is replaced, equal rows get equal ids and an empty table gives an empty result.
    ``path`` names the vocabulary file on the driver; Spark sends it to the executors.
    """
    df = df.drop(ids_col).withColumn(text_col, F.col(text_col).cast("string"))
    out = widened(df, **{ids_col: "array<int>"})
    return df.mapInArrow(partial(_encoded, name=_shipped(df, path), at=df.columns.index(text_col), fields=out.names), out)


def _decoded(batches, name: str, at: int, fields):
    bpe = tokenizer(SparkFiles.get(name))
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            texts = pa.array([bpe.decode(i or []) for i in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], fields)


def decode(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the text of every array of ids; null and empty arrays give an empty text."""
    df = df.drop(decoded_col)
    out = widened(df, **{decoded_col: "string"})
    return df.mapInArrow(partial(_decoded, name=_shipped(df, path), at=df.columns.index(ids_col), fields=out.names), out)


def _round_trips(batches, name: str, at: int, fields):
    bpe = tokenizer(SparkFiles.get(name))
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at], 1 << 20):
            texts = batch.column(at).to_pylist()
            bpe.prepare(texts)
            sizes, coded, decoded = [], [], []
            for text in texts:
                ids = bpe.encode(text)
                sizes.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(bpe.numbers.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            cols = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], fields
            )


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the text.

    Each text is encoded and its ids are decoded in one task, so neither crosses to another
    process; the digests are those of the decimal ids joined by blanks and of the decoded text. Null
    and empty texts have no ids and the digests of an empty string.
    """
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256").withColumn(text_col, F.col(text_col).cast("string"))
    out = widened(df.drop(text_col), n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    run = partial(_round_trips, name=_shipped(df, path), at=df.columns.index(text_col), fields=out.names)
    return df.mapInArrow(run, out)
