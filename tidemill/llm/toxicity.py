"""Toxicity by two class-conditional Kneser-Ney bigram models.

Both models are one chain of back-off; c is the class, u the word before w, L
the language and p the first letters of w:

    P_c(w | u) = R_c(u, w) + lambda_c(u) P_c(w | L)
    P_c(w | L) = R_c(L, w) + lambda_c(L) [d S(L, w) F_c(p | L) / S(L, p) + (1 - d) P_c(w)]
    F_c(p | L) = R_c(L, p) + lambda'_c(L) S(L, p)
    P_c(w)     = the same summed over the languages, in the same shares for both
                 classes, and for words never seen F_c(p) / V

S are shared counts of both classes with an absolute discount of ``DISCOUNT``;
what that takes away is 1 - d and goes to the next lower order. R are the class
counts above an absolute discount: what the shared counts lead one to expect and
``DEVIATIONS`` standard deviations of it. So rare expressions, and all that
chance could explain, have the probability that the shared counts give, the
same in both models up to lambda = 1 - sum(R), and cancel out; without that the
noise of thousands of ordinary words drowns a few toxic ones.

Words are counted as Kneser-Ney continuations: how many different words stand
before them in the class. A pair of words counts once per word that stands
``FAR`` places before its second: copies of a passage count once, but a fixed
phrase counts in each text. Each order sums to one (tested).

A document is toxic if the mean log-likelihood per word is larger under the
toxic model by more than a threshold, which is set on documents that the model
did not see: each half of the sample is scored by a model of the other half.

The models are fitted on a bounded sample: at most ``MAX_PER_CLASS`` labelled
documents of each class, spread over the languages, of each language the same
number of both, first by md5 of their ids; equal texts count once. Tasks count its
words and score its held-out halves, so that its texts never come to the driver.
All documents are scored, whole, in one pass without a shuffle.

Cases: a null or empty text has no words, log-likelihoods of 0 and is not
toxic; a null or unknown language is scored by P_c(w); null ids and repeated
rows are scored one by one; of very long texts every word counts; a margin equal
to the threshold is not toxic; labels that are null are ignored, of
contradicting ones the toxic one holds; without labels of both classes in any
language nothing is toxic. Only id, text and language are read, so other columns
cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, read, release
from tidemill.llm.kernels import U64, flat, give_back, mix, slices, span_hash, tidy, words

MAX_PER_CLASS = 3000
DISCOUNT = 0.75
DEVIATIONS = 3.0
PAIR_DEVIATIONS = 5.0  # pairs are many more than words
FAR = 8
LETTERS = 4
NEW_LETTERS = 0.01  # share of words whose first letters are new


@dataclass
class Table:
    """Values of both classes (toxic, ordinary) by sorted key."""

    keys: np.ndarray
    values: np.ndarray  # 2 x keys

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it there, place) of each key."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


@dataclass
class Model:
    """Probabilities of (language, word) and of words; weights of P_c(w); first letters; pairs and their histories."""

    in_language: Table
    anywhere: Table
    down: Table  # by language: weight of P_c(w)
    down_any: np.ndarray
    letters: Table
    pairs: Table
    history: Table
    size: int
    threshold: float


def _none() -> Model:
    t = lambda: Table(np.zeros(0, U64), np.zeros((2, 0)))
    return Model(t(), t(), t(), np.ones(2), t(), t(), t(), 1, np.inf)


@dataclass
class Units:
    """Words of texts: row, and keys of word, first letters, language, word before, word FAR before."""

    row: np.ndarray
    word: np.ndarray
    letters: np.ndarray
    lang: np.ndarray
    left: np.ndarray
    far: np.ndarray


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a) + b)


def units(text: pa.Array, lang: pa.Array) -> Units:
    """Of lower-case texts. The word before the first one is 0."""
    buf, off = flat(text)
    s, e, row = words(buf, off)
    head = np.flatnonzero((buf & 0xC0) != 0x80)
    nth = np.searchsorted(head, s)
    cut = np.append(head, len(buf))[np.minimum(nth + LETTERS, len(head))] if len(head) else s
    lbuf, loff = flat(lang)
    code = np.where(np.asarray(lang.is_valid()), span_hash(lbuf, loff[:-1], loff[1:]) | U64(1), U64(0))
    word = span_hash(buf, s, e)

    def before(k: int) -> np.ndarray:
        out = np.zeros(len(s), U64)
        if len(s) > k:
            out[k:] = np.where(row[k:] == row[:-k], word[:-k], U64(0))
        return out

    return Units(row, word, span_hash(buf, s, np.minimum(cut, e)), code[row], before(1), before(FAR))


def _counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts of both classes, first place of each key in the two parts) of (keys, counts) of the toxic and the ordinary class."""
    keys, first, where = np.unique(np.concatenate([k for k, _ in parts]), return_index=True, return_inverse=True)
    n = [np.bincount(w, c, minlength=len(keys)) for w, (_, c) in zip(np.split(where, [len(parts[0][0])]), parts, strict=True)]
    return keys, np.stack(n), first


def _above(n: np.ndarray, hist: np.ndarray, deviations: float, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R of both classes, lambda of both by history, pooled total by history); hist: number of each key's history; total: of both classes by history, where n has not all keys."""
    total = np.stack([np.bincount(hist, x) for x in n]) if total is None else total
    pooled = total.sum(0)
    expect = total[:, hist] * (n.sum(0) / pooled[hist])
    chance = np.sqrt(expect * (1 - total / pooled)[:, hist] + 1)
    r = np.maximum(n - expect - deviations * chance, 0) / np.maximum(total, 1)[:, hist]
    return r, 1 - np.stack([np.bincount(hist, x, minlength=len(pooled)) for x in r]), pooled


def _parts(text: pa.Array, lang: pa.Array) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, rows) in parts of bounded size: the driver's memory holds the arrays of one at a time."""
    at = 0
    for b in slices(iter([pa.RecordBatch.from_arrays([text, lang], names=["text", "lang"])]), "text", 1 << 18):
        yield at, b
        at += b.num_rows


def _class_counts(text: pa.Array, lang: pa.Array) -> tuple[np.ndarray, ...]:
    """Continuation counts of one class's texts.

    (key of language and word, count, language, word, first letters), then
    (key of pair, count, word before).
    """
    la, w, p = _distinct(text, lang, lambda u: _join(u.lang, _join(u.left, u.word)), lambda u: (u.lang, u.word, u.letters))
    keys, first, n = np.unique(_join(la, w), return_index=True, return_counts=True)
    la, w, p = la[first], w[first], p[first]
    left, pair = _distinct(text, lang, lambda u: _join(u.far, _join(u.left, u.word)), lambda u: (u.left, _join(u.left, u.word)))
    pkeys, pfirst, pn = np.unique(pair, return_index=True, return_counts=True)
    return keys, n, la, w, p, pkeys, pn, left[pfirst]


def _distinct(text: pa.Array, lang: pa.Array, key, values) -> list[np.ndarray]:
    """The values of the first word of each key, one column at a time in memory."""
    cols: list[list[np.ndarray]] = []
    for _, b in _parts(text, lang):
        u = units(b.column("text"), b.column("lang"))
        k, one = np.unique(key(u), return_index=True)
        row = [k, *(v[one] for v in values(u))]
        cols = cols or [[] for _ in row]
        for c, x in zip(cols, row, strict=True):
            c.append(x)
    if not cols:
        return [np.zeros(0, U64) for _ in values(units(text, lang))]
    once = np.unique(np.concatenate(cols.pop(0)), return_index=True)[1]
    out = []
    while cols:
        out.append(np.concatenate(cols.pop(0))[once])
    return out


def fit_counts(text: pa.Array, lang: pa.Array, toxic: np.ndarray) -> Model:
    """The two models of lower-case texts (threshold 0), counted in this process; toxic: booleans."""
    known = np.asarray(lang.is_valid())
    ev = [_class_counts(*(x.take(pa.array(np.flatnonzero(known & (toxic == c)))) for x in (text, lang))) for c in (True, False)]
    totals = []
    for *_, n, left in ev:
        lefts, at = np.unique(left, return_inverse=True)
        totals.append((lefts, np.bincount(at, n, minlength=len(lefts))))
    return _model([e[:5] for e in ev], [e[5:] for e in ev], totals)


def _model(ev: list[tuple[np.ndarray, ...]], pairs: list[tuple[np.ndarray, ...]], totals: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The two models (threshold 0) of the counts of each class.

    ev: (key of language and word, count, language, word, first letters); pairs:
    (key, count, word before), of all or of those that a class has more often than
    PAIR_DEVIATIONS; totals: (word before, count of all its pairs).
    """
    if not len(ev[0][0]) or not len(ev[1][0]):
        return _none()
    both = [np.concatenate([e[i] for e in ev]) for i in (2, 3, 4)]
    # words and their first letters, by language
    keys, n, first = _counts([(e[0], e[1]) for e in ev])
    langs, hist = np.unique(both[0][first], return_inverse=True)
    word, letters_of = both[1][first], both[2][first]
    heads, hfirst, head = np.unique(_join(both[0][first], letters_of), return_index=True, return_inverse=True)
    m = np.stack([np.bincount(head, x, minlength=len(heads)) for x in n])
    hhist, hletters = hist[hfirst], letters_of[hfirst]
    r, lam, pooled = _above(n, hist, DEVIATIONS)
    rp, lamp, _ = _above(m, hhist, DEVIATIONS)
    kept = np.maximum(n.sum(0) - DISCOUNT, 0)
    d = np.bincount(hist, kept) / pooled
    share = kept / np.bincount(hist, kept)[hist]
    hshare = np.bincount(head, share, minlength=len(heads))
    f = rp + lamp[:, hhist] * hshare
    q = r + lam[:, hist] * d[hist] * share * f[:, head] / hshare[head]
    weight = pooled / pooled.sum()
    down = lam * (1 - d)
    # without the language: the same shares of the languages for both classes
    letters, at = np.unique(hletters, return_inverse=True)
    fl = np.stack([np.bincount(at, x * weight[hhist]) for x in f]) * (1 - NEW_LETTERS)
    names, at = np.unique(word, return_inverse=True)
    size = len(names)
    plain = np.stack([np.bincount(at, x * weight[hist]) for x in q])
    down_any = (down * weight).sum(1)
    lplace = np.searchsorted(letters, hletters[head])
    whole = plain[:, at] + down_any[:, None] * (fl[:, lplace] + NEW_LETTERS / size) / size
    probs = q + down[:, hist] * whole
    any_probs = np.zeros((2, size))
    any_probs[:, at] = whole
    # pairs, by the word before
    # only one that a class has more often than PAIR_DEVIATIONS can stand above chance, whose deviation is 1 at least
    often = [(k[n > PAIR_DEVIATIONS], left[n > PAIR_DEVIATIONS]) for k, n, left in pairs]
    pkeys, first = np.unique(np.concatenate([k for k, _ in often]), return_index=True)
    lefts, phist = np.unique(np.concatenate([left for _, left in often])[first], return_inverse=True)
    n, total = np.zeros((2, len(pkeys))), np.zeros((2, len(lefts)))
    for c in (0, 1):
        hit, at = Table(pkeys, n).find(pairs[c][0])
        n[c, at[hit]] = pairs[c][1][hit]
        hit, at = Table(lefts, n).find(totals[c][0])
        total[c, at[hit]] = totals[c][1][hit]
    r, lam, _ = _above(n, phist, PAIR_DEVIATIONS, total)
    some, bent = (r > 0).any(0), (lam < 1).any(0)
    return Model(Table(keys, probs), Table(names, any_probs), Table(langs, down), down_any, Table(letters, fl), Table(pkeys[some], r[:, some]), Table(lefts[bent], lam[:, bent]), size, 0.0)


def margin(model: Model, text: pa.Array, lang: pa.Array) -> np.ndarray:
    return np.concatenate([t - o for _, t, o in (score(model, b.column("text"), b.column("lang")) for _, b in _parts(text, lang))] or [np.zeros(0)])


def best_threshold(unseen: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold between the margins of documents that the models did not see."""
    cuts = np.unique(np.append(unseen, 0.0))
    rate = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="right") / len(x)
    gain = rate(unseen[toxic]) - rate(unseen[~toxic])
    best = np.flatnonzero(gain >= gain.max() - 0.002)
    best = int(best[np.argmin(np.abs(cuts[best]))])  # of cuts as good as the best, the nearest to 0
    above = cuts[best + 1] if best + 1 < len(cuts) else cuts[best]
    return float(0.0 if cuts[best] <= 0 < above else (cuts[best] + above) / 2)


def word_probabilities(model: Model, u: Units) -> np.ndarray:
    """P_c(w | u) of each word under both models."""
    p = np.empty((2, len(u.word)))
    hit, at = model.in_language.find(_join(u.lang, u.word))
    p[:, hit] = model.in_language.values[:, at[hit]]
    rest = np.flatnonzero(~hit)
    if len(rest):
        w, size = u.word[rest], model.size
        there, at = model.letters.find(u.letters[rest])
        f = np.where(there, model.letters.values[:, at] if len(model.letters.keys) else 0.0, 0.0) + NEW_LETTERS / size
        low = model.down_any[:, None] * f / size
        there, at = model.anywhere.find(w)
        if there.any():
            low[:, there] = model.anywhere.values[:, at[there]]
        known, at = model.down.find(u.lang[rest])
        if known.any():
            low[:, known] *= model.down.values[:, at[known]]
        p[:, rest] = low
    bent, at = model.history.find(u.left)
    if bent.any():
        p[:, bent] *= model.history.values[:, at[bent]]
        bent = np.flatnonzero(bent)
        more, at = model.pairs.find(_join(u.left[bent], u.word[bent]))
        p[:, bent[more]] += model.pairs.values[:, at[more]]
    return p


def score(model: Model, text: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, mean toxic, mean ordinary log-likelihood) of each text."""
    u = units(text, lang)
    n = np.bincount(u.row, minlength=len(text))
    logs = np.log(np.maximum(word_probabilities(model, u), 1e-300))
    toxic, ordinary = (np.bincount(u.row, weights=x, minlength=len(text)) / np.maximum(n, 1) for x in logs)
    return n, toxic, ordinary


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id") -> Model:
    """The model of a bounded sample of labelled documents, balanced in each language."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("__tm_id")).agg((F.max("toxic") > 0).alias("__tm_toxic")).where("__tm_id is not null")
    docs = docs.select(id_col, "lang", "text")
    rows = docs.join(known, docs[id_col] == known["__tm_id"]).where(docs["lang"].isNotNull() & docs["text"].isNotNull())
    ids = rows.select("__tm_id", docs["lang"].cast("string").alias("__tm_lang"), "__tm_toxic").distinct().withColumn("__tm_h", F.md5(F.col("__tm_id").cast("string")))
    nth = F.row_number().over(Window.partitionBy("__tm_toxic", "__tm_lang").orderBy("__tm_h", "__tm_id"))
    # of each class the first of every language, then the second of every language, ...
    spread = ids.withColumn("__tm_nth", nth)
    picks = [spread.where(F.col("__tm_toxic") == c).orderBy("__tm_nth", "__tm_h", "__tm_lang").limit(max_per_class) for c in (True, False)]
    sample = picks[0].union(picks[1])  # bounded by the parameter, hence the broadcast
    got = docs.join(F.broadcast(sample), (docs[id_col] == sample["__tm_id"]) & (docs["lang"].cast("string") == sample["__tm_lang"]))
    got = got.select(F.monotonically_increasing_id().alias("no"), F.col("__tm_h").alias("h"), F.lower("text").alias("text"), F.col("__tm_lang").alias("lang"), F.col("__tm_toxic").alias("toxic")).where("text is not null")
    only_here = f"toxicity-{uuid.uuid4().hex}"
    try:
        return learn(cut(got, only_here), only_here)
    finally:
        release(only_here)


def _chosen(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(no, toxic, half) by no of the rows (no, h, lang, toxic, th) to learn from: equal texts once, of each language as many of both classes; of each class every other one is in half 1."""
    t = t.sort_by([("h", "ascending"), ("th", "ascending")])
    no, toxic, th = (t.column(c).to_numpy() for c in ("no", "toxic", "th"))
    code = t.column("lang").combine_chunks().dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    once = np.zeros(len(no), bool)
    once[np.unique(np.stack([code.astype(np.int64), th, toxic.astype(np.int64)], 1), axis=0, return_index=True)[1]] = True
    keep = np.zeros(len(no), bool)
    for c in np.unique(code):
        mine = [np.flatnonzero(once & (code == c) & (toxic == k)) for k in (True, False)]
        m = min(len(x) for x in mine)
        for x in mine:
            keep[x[:m]] = True
    no, toxic = no[keep], toxic[keep]
    half = np.zeros(len(no), np.int64)
    for c in (True, False):
        half[toxic == c] = np.arange((toxic == c).sum()) % 2
    order = np.argsort(no)
    return no[order], toxic[order], half[order]


def _rows(batches: Iterator[pa.RecordBatch], no: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their places in no) of the rows whose number is there, in parts of bounded size."""
    for b in slices(batches, "text", 1 << 18):
        have = b.column("no").to_numpy()
        at = np.minimum(np.searchsorted(no, have), len(no) - 1)
        hit = np.flatnonzero(no[at] == have)
        if len(hit):
            yield b.take(pa.array(hit)), at[hit]


#: Columns of counts: t, o: toxic and ordinary class; 3: all documents, 1 and 2: those of half 0 and 1.
_COUNTS = [f"{c}{seen}" for c in "to" for seen in (1, 2, 3)]


def counted(sample: DataFrame, no: np.ndarray, toxic: np.ndarray, half: np.ndarray) -> DataFrame:
    """(pair, a, w, p, _COUNTS): continuation counts of words (language, word, first letters) and, where pair is 1, of pairs (word before, pair, 0)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in _rows(batches, no):
            u = units(b.column("text"), b.column("lang"))
            side = (2 * toxic[at] + half[at])[u.row]
            both = _join(u.left, u.word)
            for pair, key, a, w, p in ((0, _join(u.lang, both), u.lang, u.word, u.letters), (1, _join(u.far, both), u.left, both, np.zeros(len(both), U64))):
                one = np.unique(_join(key, side.astype(U64)), return_index=True)[1]
                cols = [pa.array(x[one].view(np.int64)) for x in (key, a, w, p)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), pair, np.int8)), *cols, pa.array(side[one] > 1), pa.array((1 << (side[one] % 2)).astype(np.int8))], names=["pair", "key", "a", "w", "p", "toxic", "half"])

    found = sample.select("no", "text", "lang").mapInArrow(run, "pair byte, key long, a long, w long, p long, toxic boolean, half byte")
    by = ["pair", "a", "w", "p"]
    once = found.repartition("w").groupBy(*by, "key", "toxic").agg(F.bit_or("half").alias("half"))  # one shuffle for both groupings
    tally = [F.count_if((F.col("toxic") == (c == "t")) & (F.col("half").bitwiseAND(int(seen)) > 0)).cast("int").alias(c + seen) for c, seen in _COUNTS]
    return once.groupBy(*by).agg(*tally)


def learn(sample: DataFrame, owner: str) -> Model:
    """The model of the sampled rows (no, h, text, lang, toxic).

    Words are counted and held-out documents scored by tasks; the driver takes
    numbers of documents, counts of different words and of frequent pairs.
    """
    no, toxic, half = _chosen(sample.select("no", "h", "lang", "toxic", F.xxhash64("text").alias("th")).toArrow())
    if not len(no):
        return _none()
    counts = cut(counted(sample, no, toxic, half), owner)
    plain = lambda t, *names: [t.column(c).to_numpy().view(U64) for c in names]
    words = counts.where("pair = 0").select("a", "w", "p", *_COUNTS).toArrow()
    often = F.greatest("t3", "o3") > PAIR_DEVIATIONS
    pairs = counts.where((F.col("pair") == 1) & often).select("a", "w", *_COUNTS).toArrow()
    totals = counts.where("pair = 1").groupBy("a").agg(*[F.sum(c).alias(c) for c in _COUNTS]).toArrow()

    def model(seen: int) -> Model:
        parts: tuple[list, list, list] = [], [], []
        for c in "to":
            n, pn, tn = (t.column(f"{c}{seen}").to_numpy() for t in (words, pairs, totals))
            la, w, p = (x[n > 0] for x in plain(words, "a", "w", "p"))
            parts[0].append((_join(la, w), n[n > 0], la, w, p))
            left, key = (x[pn > 0] for x in plain(pairs, "a", "w"))
            parts[1].append((key, pn[pn > 0], left))
            parts[2].append((plain(totals, "a")[0], tn))
        return _model(*parts)

    halves = [model(2), model(1)]  # each half is scored by a model of the other one

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in _rows(batches, no):
            for k in (0, 1):
                mine = np.flatnonzero(half[at] == k)
                got = margin(halves[k], *(b.column(c).take(pa.array(mine)) for c in ("text", "lang")))
                yield pa.RecordBatch.from_arrays([pa.array(at[mine]), pa.array(got)], names=["at", "margin"])

    got = sample.select("no", "text", "lang").mapInArrow(run, "at long, margin double").toArrow()
    unseen = np.zeros(len(no))
    unseen[got.column("at").to_numpy()] = got.column("margin").to_numpy()
    del halves
    whole = model(3)
    if len(whole.in_language.keys):
        whole.threshold = best_threshold(unseen, toxic)
    pa.default_memory_pool().release_unused()
    return whole


def classify(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, toxic_ll, ordinary_ll, toxic, after the carried columns, for every row of docs."""
    model = train(docs, labels, max_per_class, id_col)
    src = docs.select(*[F.col(f"`{c}`").alias(f"__tm_c{i}") for i, c in enumerate(carry)], F.col(id_col).alias("__tm_id"), F.lower("text").alias("__tm_text"), F.col("lang").alias("__tm_lang"))
    kept = [c for c in src.columns if c not in ("__tm_text", "__tm_lang")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__tm_text"):
            n, tox, ordinary = score(model, b.column("__tm_text"), b.column("__tm_lang"))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(tox), pa.array(ordinary), pa.array((tox - ordinary > model.threshold) & (n > 0))],
                names=[*kept, "__tm_n", "__tm_t", "__tm_o", "__tm_x"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(kept).schema.fields)
    out = src.mapInArrow(run, f"{types}, __tm_n long, __tm_t double, __tm_o double, __tm_x boolean")
    return out.toDF(*carry, id_col, "n_words", "toxic_ll", "ordinary_ll", "toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id") -> DataFrame:
    """docs but for the toxic ones. Only text and language go to Python, and one boolean comes back."""
    model = train(docs, labels, max_per_class, id_col)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array, lang: pa.Array) -> pa.Array:
        out = []
        for b in slices(iter([pa.RecordBatch.from_arrays([text, lang], names=["text", "lang"])]), "text"):
            n, tox, ordinary = score(model, b.column("text"), b.column("lang"))
            out.append(~((tox - ordinary > model.threshold) & (n > 0)))
        give_back()
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clean(F.coalesce(F.lower("text"), F.lit("")), docs["lang"].cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
