"""Bounded-space online packing of token sequences.

Every task tokenizes its documents and keeps a fixed number of open windows.
A piece goes to the open window it fills best; when none has room, the
fullest window is emitted -- topped up with the head of the piece, which is
cut there -- and a new one opens.  The windows left open by the tasks are
merged along a tree of tasks that pack their pieces in the same way; the
root fills what remains window by window.
"""

from __future__ import annotations

import gc
import struct
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .common import cut_lineage, staged

ship_by_value(__name__)

WINDOW, OPEN, END_ID = 2048, 32, 1
#: the shortest head worth cutting off to fill a window; tasks that meet in a node of the tree
LEAST_CUT, FAN_IN = 16, 16
#: words that a worker keeps; pieces and bytes of an output batch
CACHE, ROWS, BYTES = 300_000, 1024, 2 << 20
#: bytes of text whose words are numbered together, texts compared when a task starts
SLICE, OWN_SAMPLE = 4 << 20, 8
#: letters, digits, signs and scripts on which word by word is compared with the whole
SAMPLE = "Plain Words, it's 3rd-rate! Äpfel über naïve ça x <|endoftext|> λόγος 中文 12,5%\u00a0next\u2003one \u0301alone"

PIECES = ("doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, node int")


class Pool:
    """Token ids of keys, one after the other in one array.  Beyond ``cache``
    keys the half that was asked for least often goes."""

    def __init__(self, cache: int):
        self.cache = cache
        self.known: dict = {}                             # key -> place, in order of place
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    @staticmethod
    def _longer(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _shrink(self) -> None:
        n = len(self.known)
        keep = np.sort(np.argsort(-self.hits[:n], kind="stable")[:self.cache // 2])
        keys = list(self.known)
        self.known = {keys[p]: i for i, p in enumerate(keep)}
        ids, ends = self.gather(keep)
        self.used = len(ids)
        self.ids[:self.used] = ids
        self.hits[:len(keep)] = self.hits[keep] // 2
        self.sizes[:len(keep)] = self.sizes[keep]
        self.starts[:len(keep)] = ends - self.sizes[:len(keep)]

    def _put(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at, to = len(self.known), len(self.known) + len(keys)
        self.ids = self._longer(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts, self.sizes, self.hits = (self._longer(a, to) for a in (self.starts, self.sizes, self.hits))
        self.sizes[at:to], self.starts[at:to], self.hits[at:to] = sizes, self.used + np.cumsum(sizes) - sizes, 0
        self.used += len(ids)
        self.known.update(zip(keys, range(at, to), strict=True))
        return np.arange(at, to)

    def places(self, keys: list, makers) -> np.ndarray:
        """Places of different keys; ``makers(unknown keys)`` gives numbers of
        them, their ids and their sizes.  Places hold until the next call."""
        if len(self.known) > self.cache:
            self._shrink()
        get = self.known.get
        out = np.fromiter([get(k, -1) for k in keys], np.int64, len(keys))
        new = np.nonzero(out < 0)[0]
        for at, ids, sizes in makers([keys[i] for i in new]):
            out[new[at]] = self._put([keys[i] for i in new[at]], ids, sizes)
        self.hits[out] += 1
        return out

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the places one after the other, and where each ends."""
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[place] - ends + sizes, sizes) + np.arange(total)], ends


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class Words:
    """Token ids of white-space separated words, kept in a pool.

    A batch of texts is split at ASCII white space and its words are numbered
    by Arrow; only those of its words that are not in the pool are tokenized,
    and the ids of all texts are gathered from the pool at once.  Words of
    letters, digits and signs below U+0180 are split and lower-cased here as
    the default tokenizer's own settings say and go to its BPE model piece by
    piece; the others are encoded by the whole tokenizer in one call.  No
    setting of it looks across ASCII white space, so word by word equals the
    whole text.  ``agrees`` compares the two on a fixed sample and on texts of
    the task's own; where they differ, whole texts are encoded.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = regex.compile("[\\x21-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u0148\\u014a-\\u017f]+").fullmatch
        self.split = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words, self.pieces = Pool(cache), Pool(cache)
        self.whole = not self.agrees([SAMPLE])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def agrees(self, texts: list[str]) -> bool:
        ids, ends = self.by_word(pa.array([t.encode() for t in texts], pa.binary()))
        return [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == self.encode(texts)

    def _pieces(self, pieces: list[str]):
        tokenize, letter = self.model.tokenize, self.letters.__getitem__
        shown = [p if p.isascii() else "".join(map(letter, p.encode())) for p in pieces]
        yield np.arange(len(pieces)), *_flat([[t.id for t in tokenize(s)] for s in shown])

    def _words(self, words: list[bytes]):
        texts = [w.decode("utf-8", "replace") for w in words]
        # of ASCII, what can be printed is plain
        plain = np.fromiter([(t.isascii() and t.isprintable() or self.plain(t) is not None) and "<|" not in t for t in texts],
                            bool, len(texts))
        own, odd = np.nonzero(plain)[0], np.nonzero(~plain)[0]
        if len(own):
            pieces = self.split("\n".join([texts[i] for i in own]).lower())
            different = dict.fromkeys(pieces)
            different.pop("\n", None)
            place = self.pieces.places(list(different), self._pieces)
            number = dict(zip(different, place.tolist(), strict=True)) | {"\n": -1}
            at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
            word = np.cumsum(at < 0)
            found = at >= 0
            ids, _ = self.pieces.gather(at[found])
            sizes = np.bincount(word[found], self.pieces.sizes[at[found]], len(own)).astype(np.int64)
            yield own, ids, sizes
        if len(odd):
            yield odd, *_flat(self.encode([texts[i] for i in odd]))

    def by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").cast(pa.large_string(), safe=False))
        words = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        place = self.words.places(words.dictionary.to_pylist(), self._words)
        ids, ends = self.words.gather(place[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64))
        upto = np.cumsum(lists.value_lengths().to_numpy())
        return ids, np.concatenate([[0], ends]).astype(np.int64)[upto]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (binary) texts one after the other, and where each ends."""
        if not self.whole:
            return self.by_word(texts)
        found = self.encode([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()])
        return np.array(list(chain.from_iterable(found)), np.uint32), np.cumsum([len(f) for f in found], dtype=np.int64)


def kept_words(path: str, cache: int) -> Words:
    """The worker process's own ``Words`` of a tokenizer: it outlives a task
    (the code that travels with a task does not), so the next one starts warm."""
    home = sys.modules.setdefault("_rewardlake_words", types.ModuleType("_rewardlake_words"))
    kept = vars(home).setdefault("kept", {})
    if (path, cache) not in kept:
        kept.clear()
        kept[path, cache] = Words(path, cache)
    return kept[path, cache]


def text_slices(texts: pa.Array):
    """Pieces of a text column of about ``SLICE`` bytes each, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


class Packer:
    """Open windows: lists of pieces (doc_id, start, ids, doc_tokens).
    ``put`` and ``finish`` hand back windows that are done."""

    def __init__(self, window: int, open_windows: int, least_cut: int):
        self.size, self.most, self.least = window, open_windows, least_cut
        self.windows: list[list] = []  # [room, pieces]

    def put(self, doc, start: int, ids: bytes, total: int) -> list[list]:
        done = []
        n = len(ids) // 4
        while n >= self.size:
            done.append([(doc, start, ids[:4 * self.size], total)])
            ids, start, n = ids[4 * self.size:], start + self.size, n - self.size
        while n:
            fits = [w for w in self.windows if w[0] >= n]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.windows) < self.most:
                best = [self.size, []]
                self.windows.append(best)
            else:
                full = min(self.windows, key=lambda w: w[0])
                self.windows.remove(full)
                room = full[0]
                if room >= self.least:
                    full[1].append((doc, start, ids[:4 * room], total))
                    ids, start, n = ids[4 * room:], start + room, n - room
                done.append(full[1])
                continue
            best[0] -= n
            best[1].append((doc, start, ids, total))
            if not best[0]:
                self.windows.remove(best)
                done.append(best[1])
            n = 0
        return done

    def finish(self) -> list[list]:
        """Fill what is open window by window, fullest first: all but the last are full."""
        done, room, at = [], 0, []
        for _, pieces in sorted(self.windows, key=lambda w: w[0]):
            for doc, start, ids, total in pieces:
                while ids:
                    if not room:
                        room, at = self.size, []
                        done.append(at)
                    took = min(room, len(ids) // 4)
                    at.append((doc, start, ids[:4 * took], total))
                    ids, start, room = ids[4 * took:], start + took, room - took
        self.windows = []
        return done


def _rows(windows, first: int | None, node: int) -> list[tuple]:
    out = []
    for k, pieces in enumerate(windows):
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, ids, total, None if first is None else first + k, at, node))
            at += n
    return out


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    names = [p.split()[0] for p in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _pack_task(path: str | None, window: int, open_windows: int, least_cut: int, cache: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        node = TaskContext.get().partitionId()
        seq, packer, words = node << 36, Packer(window, open_windows, least_cut), None
        end = struct.pack("<I", END_ID)
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts = batch.column("text").cast(pa.binary() if pa.types.is_string(batch.schema.field("text").type) else pa.large_binary())
            if words is None:
                words = kept_words(path or default_tokenizer(), cache)
                if not words.whole:
                    own = [t.decode("utf-8", "replace") for t in texts.slice(0, OWN_SAMPLE).to_pylist() if t]
                    words.whole = not words.agrees(own)
            docs, rows, held = batch.column("doc_id").to_pylist(), [], 0
            for first, part in text_slices(texts):
                ids, ends = words.ids(part)
                begin = 0
                for doc, stop in zip(docs[first:first + len(part)], ends.tolist(), strict=True):
                    one = ids[begin:stop].tobytes() + end
                    begin = stop
                    done = packer.put(doc, 0, one, len(one) // 4)
                    rows += _rows(done, seq, node)
                    seq += len(done)
                    held += len(one)
                    if len(rows) >= ROWS or held >= BYTES:
                        yield _batch(rows, kind)
                        rows, held = [], 0
            yield _batch(rows, kind)
        batch = texts = ids = None  # the worker lives on: give back what the batches took
        gc.collect()
        pa.default_memory_pool().release_unused()
        if kind is not None:
            yield _batch(_rows([w[1] for w in packer.windows], None, node), kind)
    return run


def _merge_task(level: int, last: bool, window: int, open_windows: int, least_cut: int):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        kind = table.schema.field("doc_id").type
        packer, done = Packer(window, open_windows, least_cut), []
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids"]))
        for r in rows:
            done += packer.put(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        if last:
            done += packer.finish()
        out = _rows(done, (level << 58) | (node << 32), node) + _rows([w[1] for w in packer.windows], None, node)
        return pa.Table.from_batches([_batch(out, kind)])
    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, open_windows: int = OPEN,
                   least_cut: int = LEAST_CUT, cache: int = CACHE) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian
    unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    A document is its token ids and then ``END_ID``; each of its ids lies in
    one piece, a sequence's pieces lie gapless from offset 0.  ``tokenizer``
    is a file every executor can read (default: the public word BPE);
    ``cache`` bounds the words a worker keeps, nothing else.  All
    sequences but one are filled to ``window`` less ``least_cut`` or more.

    Defined cases: null and empty texts are the end id alone; texts longer
    than a window fill windows of their own and pack the rest; repeated rows
    are packed each; null ids are kept; an empty table gives no sequences;
    other columns are not read.  What tasks pack is written once to the
    shared folder, because both the done and the open windows are read.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = PIECES.format(id=id_type)
    first = staged(docs.select("doc_id", "text").mapInArrow(
        _pack_task(tokenizer, window, open_windows, least_cut, cache), schema), "pieces")
    out = first.where(F.col("sequence_id").isNotNull())
    left = first.where(F.col("sequence_id").isNull())
    top = left.agg(F.max("node").alias("n")).first()["n"]
    nodes, level = (top + 1 if top is not None else 0), 0
    while nodes:
        level += 1
        last = nodes <= FAN_IN
        merged = cut_lineage(left.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int")).groupBy("node").applyInArrow(
            _merge_task(level, last, window, open_windows, least_cut), schema))
        out = out.unionByName(merged.where(F.col("sequence_id").isNotNull()))
        left = merged.where(F.col("sequence_id").isNull())
        nodes = 0 if last else -(-nodes // FAN_IN)
    return out.drop("node")
