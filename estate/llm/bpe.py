"""Byte-level BPE by traversal of a trie that shares prefixes.

The token that ends the encoding of a prefix follows from the last tokens of its own
prefixes: it is the one token that ends there and does not merge with the token before
it. So the distinct words are put into a trie, and a depth-first walk gives every new
node its last token once, however many words run through it. The encoding of a word is
read backwards along the last tokens. Words seen stay known to the worker until the
trie reaches a bound; then it starts afresh, which changes no result.

Where only the number of tokens is wanted, no trie is made: words of one length that were
not seen before are merged together, the first lowest pair of each in every round.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.llm.common import ship

MAX_NODES = 600_000
# Texts are taken together up to about so many bytes: their new words share one walk.
CHUNK_BYTES = 2_000_000
# So many ids are spelt out and decoded together.
CHUNK_IDS = 1_000_000
# Words up to so many bytes are counted by rounds, longer ones by the trie.
ROUND_BYTES = 64
# The rank of a pair that is no merge; with a place below ROUND_BYTES it fits 63 bits.
_NO_MERGE = 1 << 40
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# White space next to a blank: such a text is cut only at blanks that stand alone.
_ODD = re.compile(r" (?:\s|(?<=\s ))")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Pairs:
    """Ranks of merges by their parts, for arrays of them: a hash table with open places."""

    def __init__(self, rank: dict[tuple[int, int], int], merged: list[int]):
        self.merged = np.array(merged, np.int64)
        bits = max(4, (4 * len(rank)).bit_length())
        self.shift = np.uint64(64 - bits)
        # Probes go past the end of the places that a key can be hashed to.
        self.keys = np.full((1 << bits) + len(rank) + 1, -1, np.int64)
        self.ranks = np.full(len(self.keys), _NO_MERGE, np.int64)
        keys = np.array([a << 20 | b for a, b in rank], np.int64)
        for key, at, n in zip(keys.tolist(), self._places(keys).tolist(), rank.values()):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at] = key, n

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        wanted = keys.ravel()
        at = self._places(wanted)
        there = self.keys[at]
        out = np.where(there == wanted, self.ranks[at], _NO_MERGE)
        on = np.flatnonzero((there != wanted) & (there >= 0))
        while len(on):
            at[on] += 1
            there = self.keys[at[on]]
            out[on] = np.where(there == wanted[on], self.ranks[at[on]], _NO_MERGE)
            on = on[(there != wanted[on]) & (there >= 0)]
        return out.reshape(keys.shape)


class Bpe:
    """A vocabulary file of merges with its trie. ``pattern`` parts a text into words."""

    def __init__(self, path: str, pattern: str, max_nodes: int = MAX_NODES):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = data["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        # Of each merge its rank by parts; of each merged token its rank and parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(data["model"]["merges"]):
            left, right = (vocab[t] for t in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[left, right] = n
            self.made[self.ids[self.token[left] + self.token[right]]] = (n, left, right)
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(pattern)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.max_nodes = max_nodes
        self.apart: dict[int, bool] = {}
        self.sizes: dict[str, int] = {}  # of each piece with a blank before it, its tokens
        self.counts: dict[str, int] = {}  # of each word, its tokens
        self.pairs = _Pairs(self.rank, [self.ids[self.token[a] + self.token[b]] for a, b in self.rank])
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self._fresh()

    def _fresh(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.last, self.begin = [-1], [0]  # of each node: last token, depth where it begins
        self.known: dict[str, tuple[int, ...]] = {}
        self.apart = {} if len(self.apart) > self.max_nodes else self.apart

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether token a followed by token b is how their joined bytes are encoded.

        Undoes the merges inside both, latest first, and looks each time if the two
        tokens at the seam would have been merged before that.
        """
        limit = len(self.rank)
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            of_a, of_b = self.made.get(a), self.made.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                limit, a = of_a[0], of_a[2]
            else:
                limit, b = of_b[0] + 1, of_b[1]  # of equal pairs the left one merges first

    def _fits(self, left: int, token: int) -> bool:
        pair = left << 20 | token
        fits = self.apart.get(pair)
        if fits is None:
            fits = self.apart[pair] = left < 0 or self._stay_apart(left, token)
        return fits

    def learn(self, words: set[str]) -> None:
        """Encodings of new words. In sorted order the trie is walked depth first: each
        word goes back to where it leaves the one before and on from there.

        Only one token can end at a node, so the likely ones are tried first: the last
        token of the parent with one byte more, that byte alone, the last two together.
        """
        child, last, begin, ids, apart = self.child, self.last, self.begin, self.ids, self.apart
        path, before = [0], b""
        for word in sorted(words):
            data = word.encode("utf-8")
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            node = path[-1]
            for end in range(shared + 1, len(data) + 1):
                key = node << 8 | data[end - 1]
                parent, node = node, child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    one = begin[parent]
                    for start in (one, end - 1, begin[path[one]]):
                        token = ids.get(data[start:end])
                        if token is not None:
                            left = last[path[start]]
                            fits = apart.get(left << 20 | token)
                            if fits or fits is None and self._fits(left, token):
                                break
                    else:
                        for start in range(end - self.longest if end > self.longest else 0, end):
                            token = ids.get(data[start:end])
                            if token is not None and self._fits(last[path[start]], token):
                                break
                    last.append(token)
                    begin.append(start)
                path.append(node)
            before, out, end = data, [], len(data)
            while end:
                node = path[end]
                out.append(last[node])
                end = begin[node]
            out.reverse()
            self.known[word] = tuple(out)

    def _split(self, text: str) -> list[str]:
        parts = self.marks.split(text) if self.marks else [text]
        return [w for p in parts for w in ([p] if p in self.special else self.words.findall(p))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of whole texts. Special tokens spelt out in them get their ids."""
        split = [self._split(text) for text in texts]
        new = set().union(*split).difference(self.known)
        if len(self.last) > self.max_nodes:
            self._fresh()
            new = set().union(*split)
        new.difference_update(self.special)
        self.learn(new)
        self.known |= {t: (i,) for t, i in self.special.items()}
        find = self.known.__getitem__
        return [list(chain.from_iterable(map(find, words))) for words in split]

    def _merge(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each word has; they have two bytes or more, all as many.

        In every round each word with a merge left takes one, so all of them stay equally
        long and one that is done has as many tokens as there are rows.
        """
        tokens = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).T]
        ranks = self.pairs.find(tokens[:-1], tokens[1:])
        out, which = np.ones(len(words), np.int64), np.arange(len(words))
        while len(ranks):
            row = np.arange(len(ranks))[:, None]
            low = (ranks * ROUND_BYTES + row).min(axis=0)
            alive = low < _NO_MERGE * ROUND_BYTES
            out[which[~alive]] = len(tokens)
            if not alive.any():
                break
            if not alive.all():
                which, low, tokens, ranks = which[alive], low[alive], tokens[:, alive], ranks[:, alive]
            rank, at = low // ROUND_BYTES, low % ROUND_BYTES
            column = np.arange(len(at))
            tokens = np.where(row <= at, tokens[:-1], tokens[1:])
            tokens[at, column] = self.pairs.merged[rank]
            ranks = np.where(row[:-1] < at, ranks[:-1], ranks[1:])
            for n, has in ((at - 1, at > 0), (at, at < len(tokens) - 1)):
                n, c = n[has], column[has]
                ranks[n, c] = self.pairs.find(tokens[n, c], tokens[n + 1, c])
        return out

    def _count_words(self, words: set[str]) -> None:
        """Makes the number of tokens of each word known."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        long = set()
        for word in words.difference(self.counts):
            data = word.encode("utf-8")
            if len(data) > ROUND_BYTES:
                long.add(word)
            elif len(data) > 1:
                by_size.setdefault(len(data), []).append((word, data))
            else:
                self.counts[word] = len(data)
        for group in by_size.values():
            names, data = zip(*group)
            self.counts.update(zip(names, self._merge(list(data)).tolist()))
        if long:
            if len(self.last) > self.max_nodes:
                self._fresh()
            self.learn(long.difference(self.known))
            self.counts.update((word, len(self.known[word])) for word in long)

    def count(self, texts: list[str]) -> list[int]:
        """How many tokens each text has, without making them.

        A single blank between characters that are no white space always begins a word,
        so what stands between such blanks can be looked up whole; only pieces not seen
        before go through the pattern and the merges.
        """
        if len(self.sizes) > self.max_nodes:
            self.sizes = {}
        if len(self.counts) > self.max_nodes:
            self.counts = {}
        out = np.zeros(len(texts), np.int64)
        plain, cut = [], []
        for row, text in enumerate(texts):
            if self.marks and self.marks.search(text):
                out[row] = len(self.encode([text])[0])
            elif _ODD.search(text):
                cut.append((row, _CUT.split(text)))
            else:
                plain.append(row)
        # Equal pieces are told by Arrow, so that each is looked up once.
        parts = pc.split_pattern(pa.array([texts[row] for row in plain], pa.large_string()), " ")
        many = np.diff(parts.offsets.to_numpy())
        heads = [texts[row].split(" ", 1)[0] for row in plain]
        named = parts.flatten().dictionary_encode()
        pieces = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = set(pieces).union(*[own[1:] for _, own in cut]).difference(self.sizes)
        # The first piece of a text has no blank before it.
        first = self._sizes(list({*heads, *(own[0] for _, own in cut)}), fresh)
        size = self.sizes.__getitem__
        if plain:
            sizes = np.fromiter(map(size, pieces), np.int64, len(pieces))[named.indices.to_numpy()]
            start = np.cumsum(many) - many  # every text has a piece
            sizes[start] = [first[piece] for piece in heads]
            out[plain] = np.add.reduceat(sizes, start)
        for row, own in cut:
            out[row] = first[own[0]] + sum(map(size, own[1:]))
        return out.tolist()

    def _sizes(self, heads: list[str], fresh: set[str]) -> dict[str, int]:
        """The tokens of pieces without a blank before them; those of fresh ones, with a
        blank, are made known.

        Pieces without white space are parted all together: the blanks between them begin
        a word each, and there are no others.
        """
        bare = [piece for piece in fresh if piece and piece.isprintable() and " " not in piece]
        rest = list(fresh.difference(bare))
        words = self.words.findall(" " + " ".join(bare)) if bare else []
        begin = [n for n, word in enumerate(words) if word[0] == " "]
        heads = [piece for piece in heads if piece]
        for text in chain((" " + piece for piece in rest), heads):
            begin.append(len(words))
            words += self.words.findall(text)
        if not words:
            return {"": 0}
        self._count_words(set(words))
        tokens = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
        found = np.add.reduceat(tokens, begin).tolist()
        self.sizes.update(zip(chain(bare, rest), found))
        return {"": 0, **dict(zip(heads, found[len(fresh) :]))}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _worker_bpe(vocabulary: str, pattern: str) -> Bpe:
    """One trie per worker process, so its tasks share what they learn."""
    return Bpe(vocabulary, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of every whole text, in the order of rows.

    Null and empty texts have no tokens. Repeated rows are encoded each. Only key and
    text are read, so other columns cannot clash. An empty table gives no rows.
    ``vocabulary`` names a file that every worker can open.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(vocabulary, pattern)
        for batch in batches:
            start, size = 0, 0
            for end, length in enumerate(pc.binary_length(batch["text"]).to_pylist(), 1):
                size += length
                if size >= CHUNK_BYTES or end == len(batch):
                    ids = bpe.encode(batch["text"].slice(start, end - start).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(start, end - start), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                    )
                    start, size = end, 0

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def lengths(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens``, the number of token ids :func:`encode` gives every text.

    Null and empty texts have none. Repeated rows are counted each. Other columns are not
    read. An empty table gives no rows. No ids are made, so a row costs its text alone.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(vocabulary, pattern)
        for batch in batches:
            start, size = 0, 0
            for end, length in enumerate(pc.binary_length(batch["text"]).to_pylist(), 1):
                size += length
                if size >= CHUNK_BYTES or end == len(batch):
                    n = bpe.count(batch["text"].slice(start, end - start).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(start, end - start), pa.array(n, pa.int64())], ["doc_id", "n_tokens"]
                    )
                    start, size = end, 0

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint")


def _joined(table: pa.Array, ids: pa.Array, places: np.ndarray) -> Iterator[memoryview]:
    """The entries of ``table`` for the ids from each place to the next, as one run of bytes."""
    taken = table.take(ids)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)[places].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    for a, b in zip(ends, ends[1:]):
        yield data[a:b]


def digests(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of encoded rows."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(vocabulary, pattern)
        every = range(max(bpe.token, default=0) + 1)
        digits = pa.array([b"%d," % i for i in every], pa.large_binary())
        tokens = pa.array([bpe.token.get(i, b"") for i in every], pa.large_binary())
        for batch in batches:
            ids, ends = batch["ids"].values, batch["ids"].offsets.to_numpy()
            coded, plain, start = [], [], 0
            while start < len(batch):
                # Texts together up to about so many ids, one at least.
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK_IDS, side="right")) - 1)
                part, places = ids.slice(ends[start], ends[end] - ends[start]), ends[start : end + 1] - ends[start]
                coded += [hashlib.sha256(run[:-1]).hexdigest() for run in _joined(digits, part, places)]
                plain += [hashlib.sha256(str(run, "utf-8", "replace").encode("utf-8")).hexdigest()
                          for run in _joined(tokens, part, places)]
                start = end
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(ends), pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(
        run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
