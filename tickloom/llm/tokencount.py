"""Exact token counts at every prefix of a text, by prefix dynamic programming.

A byte-pair encoding of a prefix ends in exactly one token, and that token is
the only suffix token that is compatible with the last token of the prefix
before it: two neighbours are compatible when encoding their joint characters
gives the same two tokens again. So from left to right

    last(i), count(i) = t, count(i - len(t)) + 1   for the t ending at i that fits last(i - len(t))

stores the token count of every prefix in one pass, and questions about
truncation and budgets are answered from it without encoding anything again.

Pieces of the model never go on past a space or a line end, so a text is cut
there into chunks whose counts add up. The recurrence runs for all new chunks
of a block at once, and a worker keeps the counts of the chunks it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty
from .flat import INVERSE, Known, Store, blocks, mix, per_text, powers, prefix, span_hash

#: Chunks whose counts a worker keeps; width of the narrowest matrix of chunks; characters from which on a chunk is worked by itself.
MAX_CHUNKS, WIDE, LONG = 2_000_000, 24, 256
MARK = "▁"
_U = np.uint64
UNKNOWN = -2
START = -3


class PrefixCounter:
    """Counts for a sentencepiece BPE model with byte fallback and a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in usable}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model cross spaces or line ends")
        self.widest = max(map(len, self.ids))
        self.vocab, self.vocab_id = Known(), np.fromiter(self.ids.values(), np.int64, len(self.ids))
        cps = [np.array([ord(c) for c in p], np.uint64) + _U(1) for p in self.ids]
        self.vocab.add(np.array([self._hash(x) for x in cps], np.uint64))
        self.pairs, self.fits = Known(), Store(bool)
        self.met: dict[tuple[int, int], bool] = {}
        self.clear()

    @staticmethod
    def _hash(cp: np.ndarray) -> np.uint64:
        return mix(np.array([(cp * powers(len(cp))).sum()], np.uint64) + _U(len(cp)))[0]

    def clear(self) -> None:
        self.known, self.store = Known(), Store(np.int32)

    def merge(self, text: str) -> list[str]:
        """Encode a few characters by merging, best score first and leftmost of equals."""
        part, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(part) - 1):
                s = scores.get(part[i] + part[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return part
            part[at : at + 2] = [part[at] + part[at + 1]]

    def fit(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the last token before it."""
        h = mix((last + 4).astype(np.uint64) << _U(32) | token.astype(np.uint64))
        row = self.pairs.find(h)
        new = self.pairs.distinct_new(h, row)
        if len(new):
            ok = []
            for a, b in zip(last[new].tolist(), token[new].tolist(), strict=True):
                b = self.pieces[b]
                a = self.pieces[a] if a >= 0 else None
                ok.append(self.merge(b) == [b] if a is None else self.merge(a + b) == [a, b])
            self.fits.add(np.array(ok), np.ones(len(new), np.int64))
            self.pairs.add(h[new])
            row = self.pairs.find(h)
        return self.fits.flat[row]

    def table(self, cp: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The recurrence for many chunks at once: cp[n, w] are characters (0 after the end); returns counts[n, w]."""
        n, w = cp.shape
        c = np.zeros((n, w + 1), np.uint64)
        np.cumsum((cp.astype(np.uint64) + _U(1)) * powers(w), axis=1, out=c[:, 1:])
        inverse = powers(w + 1, INVERSE)
        last, count = np.full((n, w + 1), START, np.int64), np.zeros((n, w + 1), np.int32)
        wide = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
        for i in range(1, w + 1):
            open_ = np.flatnonzero(size >= i)
            for k in range(1, min(i, self.widest) + 1):
                if not len(open_):
                    break
                row = self.vocab.find(mix((c[open_, i] - c[open_, i - k]) * inverse[i - k] + _U(k)))
                at = np.flatnonzero(row >= 0)
                if not len(at):
                    continue
                token = self.vocab_id[row[at]]
                ok = self.fit(last[open_[at], i - k], token)
                hit = open_[at[ok]]
                last[hit, i], count[hit, i] = token[ok], count[hit, i - k] + 1
                if len(hit):
                    open_ = np.delete(open_, at[ok])
            last[open_, i], count[open_, i] = UNKNOWN, count[open_, i - 1] + wide[open_, i - 1]  # no piece has it: its bytes
        return count[:, 1:]

    def line(self, chunk: str) -> np.ndarray:
        """The recurrence for one long chunk, character by character: a few dictionary lookups each."""
        ids, pieces, met, widest = self.ids, self.pieces, self.met, self.widest
        last, count = [START], [0]
        for i in range(1, len(chunk) + 1):
            for k in range(1, min(i, widest) + 1):
                token = ids.get(chunk[i - k : i])
                if token is None:
                    continue
                pair = last[i - k], token
                ok = met.get(pair)
                if ok is None:
                    a, b = pieces[pair[0]] if pair[0] >= 0 else None, pieces[token]
                    ok = met[pair] = self.merge(b) == [b] if a is None else self.merge(a + b) == [a, b]
                if ok:
                    last.append(token)
                    count.append(count[i - k] + 1)
                    break
            else:  # no piece has it: its bytes
                last.append(UNKNOWN)
                count.append(count[i - 1] + len(chunk[i - 1].encode(errors="surrogatepass")))
        if len(met) > MAX_CHUNKS:
            met.clear()
        return np.array(count[1:], np.int32)

    def learn(self, chunks: list[str]) -> None:
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        out: list[np.ndarray | None] = [self.line(c) if len(c) > LONG else None for c in chunks]
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG]
        at = 0
        while at < len(order):  # of about equal length, so that no matrix is much wider than its rows
            w = int(size[order[at]])
            top = min(len(order), at + max(1, (1 << 20) // max(w, 1)))
            to = int(np.searchsorted(size[order[at:top]], max(w + 3, WIDE // 4), "right")) + at
            rows = order[at:to]
            w = int(size[rows[-1]])
            text = "".join(chunks[r].ljust(w, "\0") for r in rows)
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), w)
            got = self.table(cp, size[rows])
            for r, x in zip(rows.tolist(), got, strict=True):
                out[r] = x[: size[r]]
            at = to
        self.store.add(np.concatenate(out), size)

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts with a space before each: starts of the chunks, the row of each in the store, and the bounds of each text's."""
        n = len(buf)
        space, line = buf == 0x20, buf == 0x0A
        edge = np.zeros(n, bool)
        edge[0] = True
        edge[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        edge[off[(off > 0) & (off < n)]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        h = span_hash(prefix(buf), start, end)
        row = self.known.find(h)
        new = self.known.distinct_new(h, row)
        if len(new):
            if self.known.count + len(new) > MAX_CHUNKS:
                self.clear()
                new = self.known.distinct_new(h, np.full(len(h), -1))
            raw = buf.tobytes()
            self.learn([raw[a:b].decode().replace(" ", MARK) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            self.known.add(h[new])
            row = self.known.find(h)
        return start, row, per_text(start, off)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: characters before each chunk and after all, tokens likewise, and the chunks' rows in the store."""
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # the model writes both alike
        put = pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type))
        for i, j, buf, off in blocks(put):
            _, row, bounds = self.block(buf, off)
            s = self.store
            tokens = s.flat[s.first[row] + s.size[row] - 1]
            for k in range(j - i):
                own = row[bounds[k] : bounds[k + 1]]
                if off[k + 1] - off[k] == 1:  # an empty text has no tokens, not even for the space
                    own = own[:0]
                yield i + k, np.concatenate(([0], np.cumsum(s.size[own]))), np.concatenate(([0], np.cumsum(tokens[bounds[k] : bounds[k] + len(own)]))), own

    def within(self, chars: np.ndarray, tokens: np.ndarray, rows: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix that encodes to at most so many tokens, from the stored counts."""
        if tokens[-1] <= budget:
            return max(0, int(chars[-1]) - 1)
        j = int(np.searchsorted(tokens, budget, "right")) - 1  # chunks that fit as a whole; counts after them only grow
        s = self.store
        counts = s.flat[s.first[rows[j]] : s.first[rows[j]] + s.size[rows[j]]]
        fits = np.flatnonzero(tokens[j] + counts <= budget)
        return max(0, int(chars[j]) + (int(fits[-1]) + 1 if len(fits) else 0) - 1)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """A worker's one counter for a model; what it has learnt outlives a task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Token counts of documents (doc_id, text), and where a limit cuts them.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)
    and keep_chars: the characters of the longest prefix of at most ``limit``
    tokens. A null text is empty: 0 tokens. A null doc_id stays null, repeated
    rows are counted each, an empty table gives no rows, other columns are not
    read. Texts of any length are worked whole, also without a space.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("keep_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            total, keep = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k, chars, tokens, rows in c.texts(batch.column(1)):
                total[k], keep[k] = tokens[-1], c.within(chars, tokens, rows, limit)
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(total), pa.array(total > limit), pa.array(keep)], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")), run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, keep_chars bigint")


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """For each document the stored prefix counts at the chunk ends: doc_id, chars array<bigint>, tokens array<bigint>.

    tokens[i] is the exact count of the text's first chars[i] characters.
    Nulls, empty texts and repeated rows as in ``token_counts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        kind = pa.list_(pa.int64())
        for batch in batches:
            got = [(chars[1:] - 1, tokens[1:]) for _, chars, tokens, _ in c.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], kind), pa.array([x[1] for x in got], kind)], names=["doc_id", "chars", "tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")), run, "doc_id bigint, chars array<bigint>, tokens array<bigint>")
