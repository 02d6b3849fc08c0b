"""Evaluation texts leaking into training text.

CGK random walks map the edit distance of word windows to a Hamming distance: a walk repeats or advances at each step as a
random bit of the current word tells, so two windows apart by few edits fall in step again. Bit-sampling then hashes the
words seen at a few random steps; several walks and samples reach the target recall. Windows of the items are taken at
every word, those of the documents at every ``stride``-th, so a leaked stretch offers several chances. A document's hits are
verified at once, where its text is, by an exact edit alignment. Nothing is shuffled but the pairs found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that are page furniture, and numbers of paragraphs at the start of a line.
FURNITURE = (
    r"^(?:[^\n|]*\|[^\n|]*\d[^\n|]*\|[^\n|]*\d[ \t]*$"
    r"|[A-Z]{1,4} ?\d+/\d+ [–—-] \w+ \d+[ \t]*$"
    r"|[^\Wa-z\d_][^a-z\d\n]{4,80}[ \t]{2,}\d+[ \t]*$"
    r"|(?:Rn\.|§) ?(?=\d))"
)
SOFT_BREAK = re.compile(r"[-­‐‑][ \t]*\n\s*|­")
DASHES = re.compile(r"[‒-―/]|--")


@dataclass(frozen=True)
class Plan:
    """``least`` words of an item must be held with at most one in ``one_in`` edited. The rest tunes the search."""

    least: int = 30
    one_in: int = 8
    window: int = 24
    stride: int = 2
    walks: int = 6
    samples: int = 2
    steps: int = 44
    drawn: int = 6
    drift: int = 3
    seed: int = 5
    items_a_block: int = 20_000

    def draws(self) -> list[list[list[int]]]:
        rng = np.random.default_rng(self.seed)
        edges = np.linspace(0, self.steps, self.drawn + 1).astype(int)  # one step of each stretch, so that a sample spans the window
        return [[[int(rng.integers(a, b)) for a, b in zip(edges, edges[1:])] for _ in range(self.samples)] for _ in range(self.walks)]


class Words(dict):
    """Ids of normalised words by chunk of text between blanks. Id 0 stands for nothing.

    Case, accents and punctuation do not count; words joined by dashes are parts, hyphens and apostrophes inside a word
    fall away, and chunks without a letter give no word.
    """

    def __init__(self) -> None:
        super().__init__()
        self.ids: dict[str, int] = {"": 0}
        self.hashes: list[int] = [0]

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        out = []
        for part in DASHES.split(chunk) if not chunk.isalpha() else (chunk,):
            plain = "".join(c for c in unicodedata.normalize("NFKD", part).casefold() if c.isalnum())
            if not plain or plain.isdigit():
                continue
            if plain not in self.ids:
                self.ids[plain] = len(self.hashes)
                self.hashes.append(xxhash.xxh64_intdigest(plain))
            out.append(self.ids[plain])
        self[chunk] = tuple(out)
        return self[chunk]

    def of(self, text: str | None, furniture: re.Pattern) -> list[int]:
        if not text:
            return []
        return [i for chunk in SOFT_BREAK.sub("", furniture.sub("", text)).split() for i in self[chunk]]


def signatures(words: np.ndarray, hashes: np.ndarray, starts: np.ndarray, plan: Plan) -> Iterator[np.ndarray]:
    """One array of signatures of the windows at ``starts`` per walk and sample."""
    own = hashes[words]
    for walk, samples in enumerate(plan.draws()):
        with np.errstate(over="ignore"):
            mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (walk + 1 + plan.seed) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        bits = (mixed >> np.uint64(32)).astype(np.uint32)[words]
        at = starts.copy()
        out = [np.full(len(starts), walk * plan.samples + s + 1, np.uint64) for s in range(plan.samples)]
        for step in range(max(max(s) for s in samples) + 1):
            for s, steps in enumerate(samples):
                if step in steps:
                    out[s] = (out[s] ^ own[at]) * np.uint64(0x9FB21C651E98DF25)
                    out[s] ^= out[s] >> np.uint64(29)
            at += (bits[at] >> np.uint32(step)) & np.uint32(1)
        yield from out


def padded(lists: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All lists in one array, each followed by ``pad`` zeros, and where each begins."""
    sizes = np.array([len(x) for x in lists], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + pad)])
    flat = np.zeros(begins[-1] + pad, np.int64)
    for words, begin in zip(lists, begins):
        flat[begin : begin + len(words)] = words
    return flat, begins[:-1]


def holds(documents: list[np.ndarray], items: list[np.ndarray], plan: Plan) -> np.ndarray:
    """Whether each stretch of a document holds its item: ``least`` words of it in order, one in ``one_in`` edited.

    Local alignment over words (a match 1, an edit -2); a cell knows where its path began in the item and the edits so far.
    Quick, and right where it says yes; what it denies is left to ``holds_exactly``.
    """
    n, rows, width = len(items), max(map(len, documents)), max(map(len, items))
    item, document = np.full((n, width), -1, np.int64), np.full((n, rows), -2, np.int64)
    for i in range(n):
        item[i, : len(items[i])], document[i, : len(documents[i])] = items[i], documents[i]
    score = np.zeros((n, width + 1), np.int32)
    begun = np.tile(np.arange(width + 1, dtype=np.int32), (n, 1))
    edits = np.zeros_like(score)
    column, found, left = np.arange(1, width + 1, dtype=np.int32), np.zeros(n, bool), np.arange(n)
    for row in range(rows):
        if row % 8 == 0:  # those found need no more
            open_ = ~found[left]
            if not open_.any():
                break
            if not open_.all():
                left, item, document, score, begun, edits = left[open_], item[open_], document[open_], score[open_], begun[open_], edits[open_]
        same = item == document[:, row, None]
        diagonal, down = score[:, :-1] + np.where(same, 1, -2), score[:, 1:] - 2
        take = down > diagonal
        new = np.maximum(np.maximum(diagonal, down), 0).astype(np.int32)
        start = np.where(new == 0, column, np.where(take, begun[:, 1:], begun[:, :-1]))
        edited = np.where(new == 0, 0, np.where(take, edits[:, 1:] + 1, edits[:, :-1] + ~same))
        while True:  # words of the item left out, one more each time
            aside = new[:, :-1] - 2
            better = aside > new[:, 1:]
            if not better.any():
                break
            new[:, 1:] = np.where(better, aside, new[:, 1:])
            start[:, 1:] = np.where(better, start[:, :-1], start[:, 1:])
            edited[:, 1:] = np.where(better, edited[:, :-1] + 1, edited[:, 1:])
        score[:, 1:], begun[:, 1:], edits[:, 1:] = new, start, edited
        length = column - start
        found[left[((length >= plan.least) & (edited * plan.one_in <= length) & (new > 0)).any(1)]] = True
    return found


def holds_exactly(document: np.ndarray, item: np.ndarray, plan: Plan) -> bool:
    """The same for one pair, by the edit distance of every stretch of the item to every stretch of the document."""
    n = len(item)
    column, begins = np.arange(n + 1, dtype=np.int32), np.arange(n - plan.least + 1, dtype=np.int32)[:, None]
    length = column - begins
    before, limit = length < 0, np.where(length >= plan.least, length // plan.one_in, -1)
    far = np.int32(1 << 20)
    now = np.where(before, far, length).astype(np.int32)
    for word in document:
        new = np.empty_like(now)
        new[:, 0] = far
        np.minimum(now[:, :-1] + (item != word), now[:, 1:] + 1, out=new[:, 1:])
        new[length == 0] = 0  # a stretch of the document may begin anywhere
        now = np.minimum.accumulate(new - column, axis=1) + column
        now[before] = far
        if (now <= limit).any():
            return True
    return False


def leaked(documents: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, passage: str, plan: Plan = Plan(), furniture: str = FURNITURE) -> DataFrame:
    """(item_id, doc_id) of documents that hold a stretch of an item's passage, wholly or in part.

    Every document is searched at its whole length. ``items`` are a stated query set: they are read in blocks of at most
    ``plan.items_a_block``, and the corpus is searched once for each block. Null and empty texts hold nothing; passages of fewer than
    ``plan.least`` words cannot be held. Extra columns are ignored; repeated rows give one pair.
    """
    count = items.count()
    blocks = max(1, -(-count // plan.items_a_block))
    key = F.pmod(F.xxhash64(item_id), F.lit(blocks))
    out = None
    for block in range(blocks):
        rows = items.where(key == block).select(item_id, passage).where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).distinct().collect()
        pairs = _search(documents, rows, doc_id=doc_id, text=text, item_id=item_id, item_type=items.schema[item_id].dataType, plan=plan, furniture=furniture)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def _search(documents: DataFrame, rows: list, *, doc_id: str, text: str, item_id: str, item_type, plan: Plan, furniture: str) -> DataFrame:
    source = documents.select(F.col(doc_id), F.col(text).alias("_text")).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    schema = source.select(F.lit(None).cast(item_type).alias(item_id), doc_id).schema
    shared = documents.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, plan, furniture)
        for batch in batches:
            found: list[tuple[int, int]] = []
            texts, size, first = [], 0, 0
            for i, value in enumerate(batch.column("_text")):
                texts.append(value.as_py())
                size += len(texts[-1])
                if size > 4_000_000 or i == batch.num_rows - 1:
                    found += [(item, first + doc) for item, doc in search.pairs(texts)]
                    texts, size, first = [], 0, i + 1
            ids = batch.column(doc_id).take(pa.array([d for _, d in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([search.names[i] for i, _ in found], _arrow(item_type)), ids], names=[item_id, doc_id])

    return source.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Search:
    """The items' signatures, and a search of texts for them."""

    def __init__(self, items: list[tuple], plan: Plan, furniture: str) -> None:
        self.plan, self.furniture, self.words = plan, re.compile(furniture, re.M), Words()
        lists = [(name, self.words.of(passage, self.furniture)) for name, passage in items]
        lists = [x for x in lists if len(x[1]) >= plan.least]
        self.names, self.items = [n for n, _ in lists], [np.array(w, np.int64) for _, w in lists]
        flat, begins = padded([w for _, w in lists], plan.window)
        spans = [np.arange(len(w) - plan.window + 1) for _, w in lists]
        self.owner = np.concatenate([np.full(len(s), i) for i, s in enumerate(spans)] or [np.zeros(0, int)])
        self.offset = np.concatenate(spans or [np.zeros(0, int)])
        starts = (begins[self.owner] + self.offset) if len(self.owner) else np.zeros(0, np.int64)
        self.flat, self.starts = flat, starts
        self.tables = []
        for signs in signatures(flat, np.array(self.words.hashes, np.uint64), starts, plan) if len(starts) else ():
            order = np.argsort(signs, kind="stable")
            present = np.zeros(1 << 20, bool)
            present[(signs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((signs[order], order, present))

    def pairs(self, texts: list[str]) -> list[tuple[int, int]]:
        if not self.tables:
            return []
        plan = self.plan
        if len(self.words) > 2_000_000:  # chunks seen once are forgotten, the items' words are not
            self.words.clear()
        lists = [self.words.of(t, self.furniture) for t in texts]
        flat, begins = padded(lists, plan.window)
        flat = flat.astype(np.int32)
        sizes = np.array([len(x) for x in lists], np.int64)
        number = (sizes + plan.stride - 1) // plan.stride
        if not number.sum():
            return []
        doc = np.repeat(np.arange(len(lists)), number)
        place = (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * plan.stride
        starts = begins[doc] + place
        hits = []
        for (known, order, present), signs in zip(self.tables, signatures(flat, np.array(self.words.hashes, np.uint64), starts, plan)):
            near = np.flatnonzero(present[(signs & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(known, signs[near], "left"), np.searchsorted(known, signs[near], "right")
            many = high - low
            which = np.repeat(near, many)
            of = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            hits.append(np.stack([of, which], 1))
        of, which = np.unique(np.concatenate(hits), axis=0).T
        alike = self._alike(self.starts[of], starts[which], flat)
        of, which = of[alike], which[alike]
        found = np.unique(np.stack([self.owner[of], doc[which], place[which] - self.offset[of]], 1), axis=0)
        return self._verified(found, lists)

    def _alike(self, ours: np.ndarray, theirs: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Whether two windows agree in as many words, each at most ``drift`` places off, as inside a held stretch they must."""
        plan, out = self.plan, np.zeros(len(ours), bool)
        most = plan.least // plan.one_in + 1
        for i in range(0, len(ours), 1 << 16):
            part, there = ours[i : i + (1 << 16)], theirs[i : i + (1 << 16)]
            missed, left = np.zeros(len(part), np.int64), np.arange(len(part))
            for at in range(plan.window):
                word, same = self.flat[part[left] + at], np.zeros(len(left), bool)
                for shift in range(-plan.drift, plan.drift + 1):
                    same |= flat[np.maximum(there[left] + at + shift, 0)] == word
                missed[left] += ~same
                left = left[missed[left] <= most]
            out[i + left] = True
        return out

    def _verified(self, hits: np.ndarray, lists: list[list[int]]) -> list[tuple[int, int]]:
        """Hits (item, document, shift) whose alignment around the shift is close enough; near shifts are taken together."""
        if not len(hits):
            return []
        cut = (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0) | (np.diff(hits[:, 2]) > 40)
        groups = np.split(hits, np.flatnonzero(cut) + 1)
        tasks = []
        for g in groups:
            item, doc = int(g[0, 0]), int(g[0, 1])
            margin = len(self.items[item]) // self.plan.one_in + 2
            low, high = max(0, int(g[0, 2]) - margin), int(g[-1, 2]) + len(self.items[item]) + margin
            tasks.append((item, doc, np.array(lists[doc][low:high], np.int64)))
        tasks = sorted((t for t in tasks if len(t[2]) * (1 + 1 / self.plan.one_in) >= self.plan.least), key=lambda t: (len(t[2]), len(self.items[t[0]])))
        out = set()
        for i in range(0, len(tasks), 256):
            some = [t for t in tasks[i : i + 256] if self._enough(t[2], self.items[t[0]])]
            if some:
                for (item, doc, _), ok in zip(some, holds([t[2] for t in some], [self.items[t[0]] for t in some], self.plan)):
                    if ok:
                        out.add((item, doc))
                for item, doc, stretch in some:
                    if (item, doc) not in out and holds_exactly(stretch, self.items[item], self.plan):
                        out.add((item, doc))
        return sorted(out)

    def _enough(self, stretch: np.ndarray, item: np.ndarray) -> bool:
        """Fewer words in common than a held stretch keeps unedited: it can't be held."""
        return np.isin(item, stretch).sum() >= self.plan.least - self.plan.least // self.plan.one_in - 1
