"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are word lists (general insults, polite words, and lists learned from
labelled documents) and patterns (shouting, masked words, an address next to an
insult). Each fires for a document or not. A generative model holds the share
of the two classes and, for every voter, how often it fires in each class given
whether one other voter fires: the voters' accuracies and their strongest
correlations, as a forest. It is fitted by expectation and maximisation over the
counts of vote patterns, where known labels stay fixed. Its posterior labels
train a logistic regression on hashed words and voters, which scores documents.

Patterns are counted over all documents that may be learned from, and
learned lists come from all their labels; near copies count once. Each
round sends two small matrices of sums per task to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid.llm.arrowtext import Runs, mix, slices, term_runs, text_bytes
from trialbraid.llm.shared import small, stored

#: Word lists by voter; words of public dictionaries that insult, threaten or are polite.
LISTS = {
    "insult_en": "idiot idiots moron morons stupid imbecile dumb fool fools dumbass jackass",
    "contempt_en": "loser losers clown clowns pathetic worthless useless failure coward nobody",
    "disgust_en": "disgusting scum trash garbage filth filthy vermin parasite parasites pig pigs",
    "threat_en": "kill die hurt destroy burn hang shoot beat punch stab",
    "insult_de": "idiot idioten dumm dummkopf trottel depp arschloch abschaum versager feigling",
    "insult_fr": "idiot idiote imbécile crétin connard stupide ordure minable débile lâche",
    "insult_es": "idiota imbécil estúpido estúpida basura escoria cobarde inútil patético payaso",
    "polite": "please thanks thank welcome sorry danke bitte merci pardon gracias por favor",
}
ADDRESS = "you your youre du dein dich dir tu toi vous votre te usted ustedes eres"
PATTERNS = ("shouting", "exclaiming", "masked", "drawn_out", "symbols", "digits", "addressed")
#: Learned lists: least lower bound of a word's toxic share by band, and lists a band is dealt to.
BANDS, DEALT = (0.3, 0.6, 0.85), 4
#: Words of the learned lists at most, documents a word must stand in, width of its bound.
MAX_WORDS, MIN_DOCUMENTS, Z = 20_000, 6, 3.5
VOTERS = [*LISTS, *PATTERNS, *[f"learned_{b}_{i}" for b in BANDS for i in range(DEALT)]]
#: Voters that speak for clean text at first; the fit may find otherwise.
_CLEAN = {"polite", "digits"}

#: Rounds without correlations and with each forest of them; log likelihood that an edge must gain.
ROUNDS = (10, 6, 6)
EDGE = 30.0
#: Documents the regression is fitted on at most, hashed words, least z of a word, steps, ridge.
MAX_FITTED = 10_000
BUCKET_BITS = 16
WORD_Z = 4.0
STEPS, RATE, RIDGE = 300, 2.0, 1e-5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in "*@#$"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
#: Smallest word hashes that make the key of near copies.
_SKETCH = 4


def _hashes(words: str) -> np.ndarray:
    return term_runs(*text_bytes(pa.array([words]))).hash


@dataclass
class Lexicon:
    """Word hashes in order, each with the bits of the lists that hold it."""

    words: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, learned: list[tuple[int, int]]) -> Lexicon:
        """The general lists, and learned (word, voter) pairs."""
        pairs = [(int(h), i) for i, words in enumerate(LISTS.values()) for h in _hashes(words)]
        pairs += [(w % (1 << 64), voter) for w, voter in learned]
        words = np.array([w for w, _ in pairs], np.uint64)
        own, at = np.unique(words, return_inverse=True)
        bits = np.zeros(len(own), np.int64)
        np.bitwise_or.at(bits, at, np.array([1 << v for _, v in pairs], np.int64))
        return cls(own, bits)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        """Bits of the lists of every word."""
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.bits[at], 0)


def _flag(votes: np.ndarray, docs: np.ndarray, voter: str) -> None:
    votes[docs] |= 1 << VOTERS.index(voter)


def votes_of(data: np.ndarray, offsets: np.ndarray, runs: Runs, lexicon: Lexicon) -> np.ndarray:
    """One bit per voter for every text of a slice."""
    n = len(offsets) - 1
    votes = np.zeros(n, np.int64)
    owner = runs.text_of()
    bits = lexicon.of_words(runs.hash)
    np.bitwise_or.at(votes, owner, bits)

    def doc_of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, places, "right") - 1

    def counts(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    size, letters = np.diff(offsets), counts(_LETTER)
    _flag(votes, np.flatnonzero((letters >= 20) & (2 * counts(_UPPER) > letters)), "shouting")
    _flag(votes, np.flatnonzero(20 * counts(_SYMBOL) > np.maximum(size, 20)), "symbols")
    _flag(votes, np.flatnonzero(5 * counts(_DIGIT) > np.maximum(size, 20)), "digits")
    # Places where neighbouring bytes of one text make a pattern.
    same = lambda k: data[: max(len(data) - k, 0)] == data[k:]
    twice = np.flatnonzero(same(1) & (data[:-1] == ord("!"))) if len(data) else np.empty(0, int)
    _flag(votes, doc_of(twice[doc_of(twice) == doc_of(twice + 1)]), "exclaiming")
    if len(data) > 3:
        drawn = np.flatnonzero(same(1)[:-2] & same(2)[:-1] & same(3) & _LETTER[data[:-3]])
        _flag(votes, doc_of(drawn[doc_of(drawn) == doc_of(drawn + 3)]), "drawn_out")
        masked = np.flatnonzero(_LETTER[data[:-2]] & _MASK[data[1:-1]] & _LETTER[data[2:]])
        _flag(votes, doc_of(masked[doc_of(masked) == doc_of(masked + 2)]), "masked")
    # An address at most three words from a word of a list that is not polite.
    rude = np.flatnonzero(bits & ~(1 << VOTERS.index("polite")))
    spoken = np.flatnonzero(np.isin(runs.hash, _hashes(ADDRESS)))
    for step in range(-3, 4):
        near = np.intersect1d(rude, spoken + step)
        if step and len(near):
            near = near[owner[near] == owner[near - step]]
            _flag(votes, owner[near], "addressed")
    return votes


def _distinct(runs: Runs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of every text, ascending, and the bounds of the texts."""
    owner = runs.text_of()
    order = np.lexsort((runs.hash, owner))
    hashes, owner = runs.hash[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(n + 1))


def _sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key that near copies mostly share: the smallest word hashes together."""
    key = np.diff(bounds).clip(max=_SKETCH).astype(np.uint64)
    for i in range(_SKETCH):
        at = bounds[:-1] + i
        some = at < bounds[1:]
        own = np.zeros(len(key), np.uint64)
        own[some] = hashes[at[some]]
        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + own)
    return key.view(np.int64)


def _keys(texts: DataFrame) -> DataFrame:
    """(toxic, sketch, text_key) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = term_runs(*text_bytes(part.column("text")))
            sketch = pa.array(_sketches(*_distinct(runs, part.num_rows)))
            columns = [part.column("toxic"), sketch, part.column("text_key")]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "sketch", "text_key"])

    return texts.mapInArrow(run, "toxic int, sketch bigint, text_key bigint")


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, k, n): weight of toxic and of all texts (text, toxic, weight) that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = term_runs(*text_bytes(part.column("text")))
            hashes, bounds = _distinct(runs, part.num_rows)
            weight = part.column("weight").to_numpy()
            toxic = part.column("toxic").to_numpy() * weight
            word, at = np.unique(hashes, return_inverse=True)
            each = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(word.view(np.int64)),
                    pa.array(np.bincount(at, np.repeat(toxic, each), len(word))),
                    pa.array(np.bincount(at, np.repeat(weight, each), len(word))),
                ],
                names=["word", "k", "n"],
            )

    counts = texts.select("text", "toxic", "weight").mapInArrow(run, "word bigint, k double, n double")
    counts = counts.groupBy("word").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    # Weights are fractions of whole texts; the sums are whole again.
    return counts.selectExpr("word", "round(k, 3) AS k", "round(n, 3) AS n")


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """The general lists and the words that mark toxic texts among ``labelled`` (text, toxic).

    A word's toxic share counts each group of near copies once per label; its
    lower Wilson bound puts it into a band. At most ``MAX_WORDS`` words.
    """
    keyed = labelled.selectExpr("text", "toxic", "xxhash64(coalesce(text, '')) AS text_key")
    each = _keys(keyed).groupBy("sketch", "toxic", "text_key").agg(F.count("*").alias("rows"))
    first = each.groupBy("sketch", "toxic").agg(F.min(F.struct("text_key", "rows")).alias("first"))
    first = first.selectExpr("toxic AS label", "first.text_key AS key", "1D / first.rows AS weight")
    first = small(stored(first.distinct()))
    one = (F.col("text_key") == F.col("key")) & (F.col("toxic") == F.col("label"))
    held = _word_counts(keyed.join(first, one)).where(f"k >= {MIN_DOCUMENTS}")
    z2 = Z * Z
    share = f"(k + {z2 / 2}D - {Z}D * sqrt(k * (n - k) / n + {z2 / 4}D)) / (n + {z2}D)"
    best = held.selectExpr("word", f"{share} AS bound").where(f"bound >= {BANDS[0]}")
    best = best.orderBy(F.desc("bound"), "word").limit(MAX_WORDS).toArrow()
    word, bound = (best.column(c).to_numpy() for c in ("word", "bound"))
    band = np.searchsorted(BANDS, bound, "right") - 1
    voter = len(LISTS) + len(PATTERNS) + band * DEALT + word % DEALT
    return Lexicon.of(list(zip(word.tolist(), voter.tolist())))


def _with_votes(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, sketch, votes) of every text."""
    shared = texts.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lexicon(*shared.value)
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            runs = term_runs(data, offsets)
            votes = votes_of(data, offsets, runs, lists)
            sketch = _sketches(*_distinct(runs, part.num_rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sketch), pa.array(votes)],
                names=["doc_id", "sketch", "votes"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, sketch bigint, votes bigint"
    )


def _fired(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.float64)


@dataclass
class LabelModel:
    """Class share and, by class and by whether the parent fires, the rate of every voter."""

    prior: float
    parents: list[int | None]
    rates: np.ndarray  # class, parent fires, voter

    @classmethod
    def start(cls) -> LabelModel:
        rates = np.full((2, 2, len(VOTERS)), 0.05)
        for j, name in enumerate(VOTERS):
            rates[int(name not in _CLEAN), :, j] = 0.3
        return cls(0.1, [None] * len(VOTERS), rates)

    def log_odds(self, fired: np.ndarray) -> np.ndarray:
        out = np.full(len(fired), np.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parents):
            given = fired[:, parent].astype(int) if parent is not None else np.zeros(len(fired), int)
            one, zero = (self.rates[c][given, j] for c in (1, 0))
            out += np.where(fired[:, j] > 0, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return out

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(fired), -500, 500)))


def _sums(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    """By class: summed weights of all pairs of firing voters; the last row and column are all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(VOTERS) + 1
        total = np.zeros((2, size, size))
        for batch in batches:
            votes, gold, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            fired = _fired(votes)
            toxic = np.where(gold >= 0, gold, model.posterior(fired))
            fired = np.column_stack([fired, np.ones(len(fired))])
            for c, share in enumerate((1 - toxic, toxic)):
                total[c] += fired.T @ (fired * (share * n)[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"]
        )

    parts = patterns.select("votes", "gold", "n").mapInArrow(run, "sums array<double>").collect()
    size = len(VOTERS) + 1
    return sum((np.array(p.sums) for p in parts), np.zeros(2 * size * size)).reshape(2, size, size)


def _model_of(sums: np.ndarray, parents: list[int | None]) -> LabelModel:
    """The most likely model of the sums, each rate drawn a little to one firing in ten."""
    rates = np.empty((2, 2, len(VOTERS)))
    for c in (0, 1):
        one, every = np.diag(sums[c])[:-1], sums[c][-1, -1]
        for j, parent in enumerate(parents):
            if parent is None:
                rates[c, :, j] = (one[j] + 0.1) / (every + 1)
                continue
            both = sums[c][j, parent]
            rates[c, 1, j] = (both + 0.1) / (one[parent] + 1)
            rates[c, 0, j] = (one[j] - both + 0.1) / (every - one[parent] + 1)
    share = (sums[1][-1, -1] + 0.1) / (sums.sum(0)[-1, -1] + 1)
    return LabelModel(float(share), parents, np.clip(rates, 1e-9, 1 - 1e-9))


def correlations(sums: np.ndarray) -> list[tuple[float, int, int]]:
    """(gain, voter, voter), largest first: twice the log likelihood that joint rates add."""
    out = []
    for i in range(len(VOTERS)):
        for j in range(i):
            gain = 0.0
            for table in sums:
                every = max(table[-1, -1], 1e-9)
                a, b, both = table[i, i], table[j, j], table[i, j]
                cells = np.array([[both, a - both], [b - both, every - a - b + both]]).clip(0)
                expected = np.outer([a, every - a], [b, every - b]) / every
                some = (cells > 0) & (expected > 0)
                gain += 2 * (cells[some] * np.log(cells[some] / expected[some])).sum()
            out.append((float(gain), i, j))
    return sorted(out, reverse=True)


def forest(edges: list[tuple[float, int, int]], least: float = EDGE) -> list[int | None]:
    """The parent of every voter in the heaviest forest of edges above ``least``."""
    group = list(range(len(VOTERS)))
    near: dict[int, list[int]] = {j: [] for j in group}
    for gain, i, j in edges:
        if gain > least and group[i] != group[j]:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
            near[i].append(j)
            near[j].append(i)
    parents: list[int | None] = [None] * len(VOTERS)
    seen: set[int] = set()
    for root in range(len(VOTERS)):
        todo = [] if root in seen else [root]
        seen.add(root)
        while todo:
            at = todo.pop()
            for to in near[at]:
                if to not in seen:
                    seen.add(to)
                    parents[to] = at
                    todo.append(to)
    return parents


def fit_label_model(patterns: DataFrame) -> LabelModel:
    """Fit to ``patterns`` (votes, gold: the label or -1, n)."""
    model = LabelModel.start()
    for phase, rounds in enumerate(ROUNDS):
        for _ in range(rounds):
            sums = _sums(patterns, model)
            model = _model_of(sums, model.parents)
        # Labels that know the last forest show the next one more clearly.
        if phase + 1 < len(ROUNDS):
            model = _model_of(sums, forest(correlations(sums)))
    return model


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Classifier:
    """Weights of hashed words, weights of voters, and the bias."""

    lexicon: Lexicon
    words: np.ndarray
    voters: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        runs = term_runs(data, offsets)
        votes = votes_of(data, offsets, runs, self.lexicon)
        bucket, owner = _buckets(runs.hash), runs.text_of()
        used = self.words[bucket] != 0
        pairs = np.unique((owner[used] << BUCKET_BITS) + bucket[used])
        held, which = pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)
        logit = self.bias + _fired(votes) @ self.voters
        logit += np.bincount(held, self.words[which], len(votes))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _with_buckets(texts: DataFrame) -> DataFrame:
    """(sketch, buckets): distinct hashed words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            runs = term_runs(*text_bytes(part.column("text")))
            sketch = pa.array(_sketches(*_distinct(runs, part.num_rows)))
            pairs = np.unique((runs.text_of() << BUCKET_BITS) + _buckets(runs.hash))
            bounds = np.searchsorted(pairs, np.arange(part.num_rows + 1) << BUCKET_BITS)
            held = pa.array((pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), held)
            yield pa.RecordBatch.from_arrays([sketch, lists], names=["sketch", "buckets"])

    return texts.select("text").mapInArrow(run, "sketch bigint, buckets array<int>")


def _fit_classifier(lexicon: Lexicon, votes: np.ndarray, words: pa.Array, label: np.ndarray) -> Classifier:
    """Logistic regression on posterior labels; words with no clear link to them have no weight."""
    n = len(votes)
    bucket = words.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n, dtype=np.int32), words.value_lengths().to_numpy(zero_copy_only=False))
    size = 1 << BUCKET_BITS
    share = label.mean() if n else 0.0
    held = np.bincount(bucket, minlength=size)
    toxic = np.bincount(bucket, label[row], size)
    spread = np.sqrt(np.maximum(held * share * (1 - share) * (1 - held / max(n, 1)), 1e-9))
    clear = (np.abs(toxic - held * share) / spread >= WORD_Z) & (held >= MIN_DOCUMENTS)
    kept = clear[bucket]
    row, bucket = row[kept], bucket[kept]
    fired = _fired(votes)
    weights, voters = np.zeros(size), np.zeros(len(VOTERS))
    bias = float(np.log((share * n + 0.1) / ((1 - share) * n + 0.9)))
    # Steps by the running sizes of the slopes, so that rare words move as fast as common ones.
    sizes = [np.full(size, 1e-12), np.full(len(VOTERS), 1e-12), 1e-12]
    for _ in range(STEPS if n else 0):
        logit = bias + np.bincount(row, weights[bucket], n) + fired @ voters
        error = (1 / (1 + np.exp(-logit)) - label) / n
        slopes = [
            np.bincount(bucket, error[row], size) + RIDGE * weights,
            error @ fired + RIDGE * voters,
            error.sum(),
        ]
        sizes = [a + s * s for a, s in zip(sizes, slopes)]
        step = [RATE * s / np.sqrt(a) / 4 for s, a in zip(slopes, sizes)]
        weights, voters, bias = weights - step[0], voters - step[1], bias - step[2]
    return Classifier(lexicon, np.where(clear, weights, 0.0), voters, float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of ``docs`` (doc_id, text), all of which may be learned from.

    ``labels`` (doc_id, toxic) may cover some of them; of repeated labels the
    highest counts, null ones do not. Lists and label model see all documents;
    the regression sees at most ``MAX_FITTED`` groups of near copies, those
    with the smallest keys. Without any label the general lists decide.
    """
    gold = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    gold = small(stored(gold.agg(F.max(F.expr("cast(toxic > 0 AS int)")).alias("toxic"))))
    docs = docs.select("doc_id", "text")
    lexicon = learn_lexicon(docs.join(gold, "doc_id"))

    voted = stored(_with_votes(docs, lexicon))
    rows = voted.join(gold, "doc_id", "left").selectExpr("sketch", "votes", "coalesce(toxic, -1) AS gold")
    patterns = rows.distinct().groupBy("votes", "gold").agg(F.count("*").alias("n"))
    model = fit_label_model(stored(patterns))

    # The documents of the smallest keys, one of each group of near copies.
    key = "xxhash64(sketch)"
    last = voted.selectExpr(f"{key} AS key").distinct().orderBy("key").limit(MAX_FITTED)
    last = last.agg(F.max("key")).first()[0]
    few = voted.where(f"{key} <= {last}") if last is not None else voted.limit(0)
    few = few.groupBy("sketch").agg(F.min("doc_id").alias("doc_id"))
    few = docs.join(F.broadcast(few), "doc_id")  # at most MAX_FITTED rows
    shown = _with_buckets(few).dropDuplicates(["sketch"])
    own = voted.groupBy("sketch").agg(F.max("votes").alias("votes"))
    table = shown.join(own, "sketch").select("sketch", "buckets", "votes").toArrow().sort_by("sketch")
    votes = table.column("votes").to_numpy()
    label = model.posterior(_fired(votes))
    words = pa.concat_arrays(table.column("buckets").chunks or [pa.array([], pa.list_(pa.int32()))])
    return _fit_classifier(lexicon, votes, words, label)


def score_documents(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score, predicted) of every whole text: 0 to 1, and 1 from a score of 0.5.

    A null text counts as empty; an empty text has the score of a document
    for which no voter fires. Repeated rows repeat their result; other columns
    are not read.
    """
    lists, c = classifier.lexicon, classifier
    shared = docs.sparkSession.sparkContext.broadcast(
        (lists.words, lists.bits, c.words, c.voters, c.bias)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits, *weights = shared.value
        own = Classifier(Lexicon(words, bits), *weights)
        for part in slices(batches):
            score = own.score(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )
