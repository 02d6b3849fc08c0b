"""Personal information inside free text: a linear-chain conditional random field over word-shape features.

The field is trained in numpy from the small labelled table of ``pii_labels`` and decoded by Viterbi in numpy batches.
A token's score is a sum over its neighbours' features, so scores are tables by distinct token and are looked up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import pii_labels

KINDS = tuple(pii_labels.LABELS.values())
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
OPENING, INNER = [i for i, t in enumerate(TAGS) if t[0] == "B"], [i for i, t in enumerate(TAGS) if t[0] == "I"]
#: A token keeps one blank before it, which tells whether it is glued to the one before.
TOKEN = re.compile(r"\n+| ?[^\W_]+| ?[^\w\s]| ?_")
REACH = 3
#: How words for ways end in the labelled table, as these are often one word with their name.
STREET_ENDINGS = frozenset(s.rstrip(".")[-3:] for s in pii_labels.STREETS["de"][1])


def word_features(word: str, given: frozenset[str], known: frozenset[str] | None) -> list[str]:
    """Shape, letter case, endings of ways and, for words among ``known``, identity. The first name list is one feature."""
    glued, word = word[0] != " ", word.lstrip(" ")
    low = word.lower()
    shape = re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", re.sub(r"\d", "d", word))
    out = [f"s={re.sub(r'(x)x+|(X)X+', lambda m: (m.group(1) or m.group(2)) + '+', shape)}"]
    if known is None or low in known:
        out.append(f"w={low}")
    if glued:
        out += ["glued", f"glued={'a' if word.isalpha() else 'd' if word.isdigit() else low[:1]}"]
    if word.isalpha():
        out += ["alpha", f"len={min(len(word), 6)}"]
        out += [f"e3={low[-3:]}"] if len(low) > 4 and low[-3:] in STREET_ENDINGS else []
        if low in given:
            out.append("given")
            out.append("given=" + ("U" if word.isupper() else "T" if word[0].isupper() else "l"))
    elif any(c.isdigit() for c in word):
        out += ["digits", f"n={min(len(word), 14)}", "alldigits" if word.isdigit() else "mixed"]
    else:
        out += ["mark"]
    return out


#: Titles are no part of a name.
TITLES = frozenset("dr me mme m mr ms mrs herr frau maître prof .".split())
#: Words that a name has in lower case; another one inside it parts two names.
PARTICLES = frozenset("van von der den de du des la le zu zur della di da dos bin al el ter ten o d l mac mc".split())
MARKS = {".": 11, ",": 12, "-": 13, "'": 13, "’": 13}


def word_class(word: str, given: frozenset[str], known: frozenset[str]) -> int:
    """One of 16 classes (0 is a gap); runs of four of them are features too."""
    word = word.lstrip(" ")
    low = word.lower()
    if word.isalpha():
        if len(word) == 1 and word.isupper():
            return 1
        if low in given:
            return 2
        case = 0 if word.islower() else 2 if word.isupper() else 1
        return (3, 5, 7)[case] + (low in known)
    if word.isdigit():
        return 9
    return 10 if any(c.isdigit() for c in word) else MARKS.get(word, 14)


#: Runs seen less often in training tell nothing.
RARE = 12
#: Which four neighbours' classes make a run.
RUNS = ((-1, 0, 1, 2), (-2, -1, 0, 1))


def _run_codes(classes: np.ndarray) -> list[np.ndarray]:
    """Per token, the code of each run of classes around it, along the last axis; outside are gaps."""
    n, out = classes.shape[-1], []
    wide = np.concatenate([np.zeros((*classes.shape[:-1], REACH), np.int32), classes.astype(np.int32), np.zeros((*classes.shape[:-1], REACH), np.int32)], -1)
    for run in RUNS:
        code = np.zeros(classes.shape, np.int32)
        for o in run:
            code = code * 16 + wide[..., REACH + o : REACH + o + n]
        out.append(code)
    return out


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray  # neighbour, feature, tag
    runs: np.ndarray  # run, code of four classes, tag
    between: np.ndarray  # tag, tag
    given: frozenset[str]
    known: frozenset[str]

    def row(self, word: str) -> list[int]:
        return [self.features[f] for f in word_features(word, self.given, self.known) if f in self.features]


def _tokens(text: str) -> tuple[list[str], np.ndarray]:
    """Words and marks, and which of them begin a line."""
    raw = TOKEN.findall(text)
    words, first, line = [], [], True
    for w in raw:
        if w[0] == "\n":
            line = True
        else:
            words.append(w)
            first.append(line)
            line = False
    return words, np.array(first, bool)


def _allowed() -> np.ndarray:
    """An inner tag only follows its own kind."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = False
            ok[j - 1, j] = ok[j, j] = True
    return ok


@lru_cache(maxsize=4)
def train(given_names: tuple[str, ...] = (), copies: int = 30, rounds: int = 10, batches: int = 10, decay: float = 1e-5, seed: int = 3) -> Model:
    """Fit by Adam on the conditional likelihood, in ``batches`` batches a round. The labelled table has each row ``copies`` times."""
    given = frozenset(g.lower() for g in given_names)
    sentences = []
    for pieces in pii_labels.labelled(sorted(given_names), copies, seed):
        words, tags, first, broken = [], [], [], True
        for text, label in pieces:
            part, begins = _tokens(text)
            if part:
                begins[0] = broken or "\n" in text[: len(text) - len(text.lstrip())]
                broken = False
            broken |= "\n" in text[len(text.rstrip()) :]
            words += part
            first += list(begins)
            if label and part:
                b = TAGS.index(f"B-{label}")
                tags += [b] + [b + 1] * (len(part) - 1)
            else:
                tags += [0] * len(part)
        if words:
            sentences.append((words, tags, first))
    known = pii_labels.LEXICON - given
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in sentences for w in s[0]}), 1)}
    seen = Counter(f for w in vocabulary for f in word_features(w, given, known))
    features = {f: i for i, f in enumerate(["line", "edge", *sorted(f for f, n in seen.items() if n >= 8 or not f.startswith("e3"))])}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sentences))
    sentences = sorted((sentences[i] for i in order), key=lambda s: len(s[0]))
    longest = max(len(s[0]) for s in sentences)
    n, tags = len(sentences), len(TAGS)
    ids, gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    line = np.zeros((n, longest), bool)
    for i, (words, tag, first) in enumerate(sentences):
        k = len(words)
        ids[i, :k], gold[i, :k], mask[i, :k], line[i, :k] = [vocabulary[w] for w in words], tag, True, first
    pairs = [(i, features[f]) for w, i in vocabulary.items() for f in word_features(w, given, known) if f in features]
    pairs.append((0, features["edge"]))
    type_of, feature_of = np.array(pairs).T
    by_type, by_feature = np.argsort(type_of, kind="stable"), np.argsort(feature_of, kind="stable")
    feature_by_type, type_starts = feature_of[by_type], np.flatnonzero(np.diff(type_of[by_type], prepend=-1))
    typed = type_of[by_type][type_starts]
    type_sorted, feature_sorted = type_of[by_feature], feature_of[by_feature]
    feature_starts = np.flatnonzero(np.diff(feature_sorted, prepend=-1))
    near = range(-REACH, REACH + 1)

    def shifted(a: np.ndarray, o: int) -> np.ndarray:
        out = np.zeros_like(a)
        if o < 0:
            out[:, -o:] = a[:, :o]
        else:
            out[:, : a.shape[1] - o] = a[:, o:]
        return out

    classes = np.array([0, *(word_class(x, given, known) for x in vocabulary)])[ids]
    codes, kinds = [], []
    for c in _run_codes(classes):
        k, inverse, often = np.unique(c, return_inverse=True, return_counts=True)
        codes.append(np.where((often >= RARE)[inverse.reshape(c.shape)], inverse.reshape(c.shape), len(k)))  # the last is for rare runs
        kinds.append(k)
    ok, start = _allowed(), np.array([t[0] != "I" for t in TAGS])
    parts = []
    for p in range(batches):  # every batches-th passage, cut to its longest
        cut = mask[p::batches].any(0)
        i_, g_, m_, l_ = (x[p::batches][:, cut] for x in (ids, gold, mask, line))
        both = m_[:, 1:]
        seen_pairs = np.zeros((tags, tags))
        np.add.at(seen_pairs, (g_[:, :-1][both], g_[:, 1:][both]), 1)
        c_ = [c[p::batches][:, cut][m_] for c in codes]
        parts.append((m_, both, seen_pairs, g_[m_], [shifted(i_, o)[m_] for o in near], [shifted(l_, o)[m_] for o in near], c_))
    w, b = np.zeros((len(near), len(features), tags)), np.zeros((tags, tags))
    r = [np.zeros((len(k) + 1, tags)) for k in kinds]
    moments = [np.zeros_like(x) for x in (w, w, b, b, r[0], r[0], r[1], r[1])]
    for step in range(1, rounds * batches + 1):
        m_, both, seen_pairs, target, views, lines, c_ = parts[step % batches]
        count, longest = m_.shape
        lengths = m_.sum(1)
        score = r[0][c_[0]] + r[1][c_[1]]
        for o in range(len(near)):
            table = np.zeros((len(vocabulary) + 1, tags))
            table[typed] = np.add.reduceat(w[o][feature_by_type], type_starts)
            score += table[views[o]] + lines[o][:, None] * w[o, 0]
        full = np.zeros((count, longest, tags))
        full[m_] = score
        e = np.exp(full - full.max(2, keepdims=True))
        m = np.where(ok, np.exp(b), 0)
        alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((count, longest))
        for t in range(longest):
            a = e[:, 0] * start if t == 0 else (alpha[:, t - 1] @ m) * e[:, t]
            scale[:, t] = a.sum(1)
            alpha[:, t] = a / a.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            back = ((beta[:, t + 1] * e[:, t + 1]) @ m.T) / scale[:, t + 1, None]
            beta[:, t] = np.where((t + 1 < lengths)[:, None], back, 1.0)
        gamma = alpha * beta
        residual = -(gamma / gamma.sum(2, keepdims=True))[m_]
        residual[np.arange(len(target)), target] += 1
        grad = np.zeros_like(w)
        for o in range(len(near)):
            per_type = np.stack([np.bincount(views[o], residual[:, tag], len(vocabulary) + 1) for tag in range(tags)], 1)
            grad[o][feature_sorted[feature_starts]] = np.add.reduceat(per_type[type_sorted], feature_starts)
            grad[o, 0] = residual[lines[o]].sum(0)
        right = (e[:, 1:] * beta[:, 1:] / scale[:, 1:, None])[both]
        expected = (alpha[:, :-1][both].T @ right) * m
        pair_grad = np.where(ok, seen_pairs - expected, 0)
        rate = 0.1 * min(1.0, 2 * (1 - step / (rounds * batches + 1)))
        run_grad = [np.stack([np.bincount(c, residual[:, tag], len(k) + 1) for tag in range(tags)], 1) for c, k in zip(c_, kinds)]
        for x in run_grad:
            x[-1] = 0
        for x, g, i in ((w, grad, 0), (b, pair_grad, 2), (r[0], run_grad[0], 4), (r[1], run_grad[1], 6)):
            g = g / count - decay * x
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            x += rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
        # what leads to an opening tag counts the same for every kind, which lets Viterbi look for it once
        into = b[:, OPENING]
        b[:, OPENING] = into.mean(1, keepdims=True) + into.mean(0) - into.mean()
    runs = np.zeros((len(RUNS), 16**4, tags), np.float32)
    for i, k in enumerate(kinds):
        runs[i, k] = r[i][:-1]
    return Model(features, w.astype(np.float32), runs, np.where(ok, b, -1e4).astype(np.float32), given, known)


class Tagger:
    """Decodes texts; scores of distinct tokens are kept from text to text."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        edge = self.model.weights[:, self.model.features["edge"]]
        self.table, self.size, self.classes = np.zeros((len(edge), 1 << 12, len(TAGS)), np.float32), 1, [0]
        self.table[:, 0] = edge

    def _id(self, word: str) -> int:
        i = self.ids[word] = self.size
        if i == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        self.classes.append(word_class(word, self.model.given, self.model.known))
        self.table[:, i] = self.model.weights[:, self.model.row(word)].sum(1)
        self.size += 1
        return i

    def mentions(self, texts: list[str], spans: bool = False) -> list[list[tuple]]:
        """Per text (kind, key), or with ``spans`` (kind, begin, end) in order."""
        if self.size > 300_000:
            self.reset()
        ids = self.ids
        lists = [TOKEN.findall(t) if t else [] for t in texts]
        flat, gap = [], [0] * REACH
        for raw in lists:
            flat += gap
            flat += [(-1 if w[0] == "\n" else ids[w] if w in ids else self._id(w)) for w in raw]
        flat += gap
        codes = np.array(flat, np.int32)
        line = np.zeros(len(codes), bool)
        line[1:] = codes[:-1] <= 0
        kept = codes >= 0
        line, stream = (line & (codes > 0))[kept], codes[kept]
        n = len(stream)
        first, second = _run_codes(np.array(self.classes, np.int32)[stream])
        score = self.model.runs[0].take(first, axis=0) + self.model.runs[1].take(second, axis=0)
        for o in range(-REACH, REACH + 1):
            low, high = max(0, -o), min(n, n - o)
            score[low:high] += self.table[o + REACH].take(stream[low + o : high + o], axis=0)
            begins = np.flatnonzero(line[low + o : high + o]) + low
            score[begins] += self.model.weights[o + REACH, 0]
        tags = self._decode(score, stream == 0)
        return self._collect(texts, lists, np.flatnonzero(kept), tags, spans)

    def _decode(self, score: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Viterbi over whole texts, texts of like length together; gaps part them."""
        n = len(score)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ~gap, [False]])))
        starts, ends = edges[::2], edges[1::2]
        tags = np.zeros(n, np.int8)
        order = np.argsort(ends - starts, kind="stable")
        between = self.model.between
        out_of, lead = np.ascontiguousarray(between[:, 0]), between[:, OPENING[0]].copy()
        kind = between[0, OPENING] - between[0, OPENING[0]]
        first, again = between[OPENING, INNER], between[INNER, INNER]
        sizes, i = (ends - starts)[order], 0
        while i < len(order):
            upto = i + 1  # what Viterbi keeps for a batch is bounded, but for a single text
            while upto < len(order) and sizes[upto] * (upto + 1 - i) < 8_000_000:
                upto += 1
            part, i = order[i:upto], upto
            begin, size = starts[part], ends[part] - starts[part]
            longest, m = size.max(), len(part)
            to_o, to_b, goes_on = np.zeros((longest, m), np.int8), np.zeros((longest, m), np.int8), np.zeros((longest, m, len(KINDS)), bool)
            final = np.zeros((m, len(TAGS)), np.float32)
            rows, done = np.arange(m), 0
            for t in range(longest):
                while size[done] <= t:  # sorted by size: the shortest are done
                    done += 1
                now = score[begin[done:] + t]
                if t == 0:
                    best = now.copy()
                    best[:, INNER] = -1e4
                else:
                    best = best[-(m - done) :]
                    o, b = best + out_of, best + lead
                    to_o[t, done:], to_b[t, done:] = o.argmax(1), b.argmax(1)
                    opened, held = best[:, OPENING] + first, best[:, INNER] + again
                    goes_on[t, done:] = held > opened
                    new = now
                    new[:, 0] += o.max(1)
                    new[:, OPENING] += b.max(1)[:, None] + kind
                    new[:, INNER] += np.maximum(opened, held)
                    best = new
                last = size[done:] == t + 1
                final[done:][last] = best[last]
            tag = final.argmax(1)
            for t in range(longest - 1, -1, -1):
                low = np.searchsorted(size, t, "right")
                tag_now = tag[low:]
                tags[begin[low:] + t] = tag_now
                if t:
                    k = (tag_now - 1) // 2
                    inner = (tag_now > 0) & (tag_now % 2 == 0)
                    held = goes_on[t, low:][rows[: m - low], np.maximum(k, 0)]
                    tag[low:] = np.where(inner, tag_now - 1 + held, np.where(tag_now == 0, to_o[t, low:], to_b[t, low:]))
        return tags

    def _collect(self, texts: list[str], lists: list[list[str]], kept: np.ndarray, tags: np.ndarray, spans: bool) -> list[list[tuple]]:
        """``kept``: where the tagged tokens are among all tokens of all texts, each text after a gap."""
        at, marked = 0, np.flatnonzero(tags)
        places, kinds = kept[marked], tags[marked]
        bounds = np.searchsorted(places, np.cumsum([0] + [len(raw) + REACH for raw in lists]))
        # a mention goes on where the next token, breaks of lines aside, is inside it
        cut = np.concatenate([[True], (np.diff(marked) != 1) | (kinds[1:] % 2 == 1)]) if len(marked) else np.zeros(0, bool)
        out = []
        for i, (text, raw) in enumerate(zip(texts, lists)):
            at += REACH
            low, high = bounds[i], bounds[i + 1]
            found: list[tuple] = []
            if low < high:
                matches = list(TOKEN.finditer(text)) if spans else []
                for part in np.split(np.arange(low, high), np.flatnonzero(cut[low + 1 : high]) + 1):
                    kind = KINDS[(int(kinds[part[0]]) - 1) // 2]
                    own = (places[part] - at).tolist()
                    words = [raw[j].lstrip(" ") for j in own]
                    if kind == "person_name":
                        while words and words[0].lower() in TITLES:
                            words, own = words[1:], own[1:]
                    key = "".join(c for w in words for c in w if c.isalnum()).lower()
                    if not _plausible(kind, words, key):
                        continue
                    if spans:
                        real = [j for j, w in enumerate(words) if w.isalnum() or w == "+" or (w == "(" and j + 1 < len(words))]
                        first = matches[own[real[0]]]
                        found.append((kind, first.end() - len(words[real[0]]), matches[own[real[-1]]].end()))
                    else:
                        found.append((kind, key))
            out.append(found if spans else list(dict.fromkeys(found)))
            at += len(raw)
        return out


def _plausible(kind: str, words: list[str], key: str) -> bool:
    """What every mention of its kind has: an exact check of form after the field's decision."""
    numbers = sum(c.isdigit() for c in key)
    if kind == "email":
        return len(key) >= 6 and ("@" in words or "at" in [w.lower() for w in words])
    if kind == "phone":
        return 7 <= numbers <= 15 and numbers == len(key)
    if kind == "id_number":
        return 6 <= numbers <= 15 and not re.search(r"[^\W\d_]{4}", " ".join(words))
    if kind == "street_address":
        return 1 <= numbers <= 7 and any(len(w) > 1 and w.isalpha() for w in words)
    small = [w for w in words if w.isalpha() and w.islower()]
    if len(small) < sum(w.isalpha() for w in words) and not PARTICLES.issuperset(small):
        return False
    long = [w for w in words if len(w) > 2 and w[0].isalpha()]
    return bool(long) and 2 <= len([w for w in words if w[0].isalpha()]) <= 8


def _run(documents: DataFrame, given_names: DataFrame, doc_id: str, text: str, out: T.StructType, spans: bool, emit) -> DataFrame:
    names = tuple(sorted(r[0] for r in given_names.where(F.col("given_name").isNotNull()).select("given_name").distinct().collect()))
    shared = documents.sparkSession.sparkContext.broadcast(train(names))
    source = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_doc IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and size < 4_000_000:
                    size += len(texts[end] or "")
                    end += 1
                yield emit(batch.column("_doc").slice(begin, end - begin), texts[begin:end], tagger.mentions(texts[begin:end], spans), out.names)
                begin = end

    return source.mapInArrow(run, out)


def find(documents: DataFrame, given_names: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_key): each distinct mention per document, in whole texts. Null and empty texts have none.

    ``given_names`` is a fixed list of names, read on the driver, where the field is trained once per list.
    """
    out = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField("pii_type", T.StringType()), T.StructField("pii_key", T.StringType())])

    def emit(ids, texts, found, names):
        del texts
        at = [i for i, f in enumerate(found) for _ in f]
        kinds, keys = [k for f in found for k, _ in f], [k for f in found for _, k in f]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(keys, pa.string())], names=names)

    return _run(documents, given_names, doc_id, text, out, False, emit)


def redact(documents: DataFrame, given_names: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, mentions): every mention replaced by its type in brackets, all else unchanged. A null text stays null."""
    out = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(text, T.StringType()), T.StructField("mentions", T.IntegerType())])

    def emit(ids, texts, found, names):
        clean = []
        for value, spans in zip(texts, found):
            for kind, begin, end in reversed(spans):
                value = f"{value[:begin]}[{kind.upper()}]{value[end:]}"
            clean.append(value)
        return pa.RecordBatch.from_arrays([ids, pa.array(clean, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=names)

    return _run(documents, given_names, doc_id, text, out, True, emit)
