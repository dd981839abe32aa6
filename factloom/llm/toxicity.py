"""Toxicity scores: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

Features (per document): densities of word lists, second-person words and how often they stand near listed words, rates of
capitals, punctuation and obfuscated spellings, and length. They are the only inputs of a score. Four lists are fixed (below);
a fifth is learned, since no fixed list fits every language: words and word beginnings that toxic training texts have far
more often than clean ones, with the logarithm of that ratio as their weight.

A text is split at white space, and each distinct token is described once while a worker remembers it (the tables are
bounded); sums over the tokens' rows give the features, so the cost hardly depends on how much a description looks at.

Training: labelled rows whose crc32(doc_id as text) mod 5 is 0 are held out. Of the others about TRAIN_ROWS ids at most, and
of their distinct texts about TRAIN_ROWS at most, are used, chosen by hash: the one bounded sample here. A document with several labels, or a text with several documents, counts
as toxic if at least half of the labels say so. The distinct texts of each class are dealt evenly to PARTS parts (fewer if a
class has fewer texts), and each part is described by a list learned on the others: no text is described by words learned
from itself or a copy, and all lists are learned on equally many texts. The trees are fitted on all parts but the first, the
calibration on the first; scoring uses the first part's list, so the calibration sees just what scoring will see.

Defined results: null and empty texts have all features 0 and get the score of such; a null doc_id counts as held out;
repeated rows get equal scores; with fewer than two distinct training texts of either class the score is h / (h + 2), h the
listed words found; an empty table gives an empty result. Input columns named score or predicted are replaced, all others
pass through unchanged.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, number_rows

#: Insults, coarse words and threats in the corpus's languages, without words that are plain ones in another.
INSULTS = """
asshole bastard bitch brainless clown coward creep cretin degenerate disgrace disgusting dumb dumbass fool freak garbage
idiot idiotic idiots ignorant imbecile jerk liar loser losers lowlife lunatic moron moronic morons parasite pathetic
scum scumbag shameful sleazy stupid stupidity trash ugly useless vermin vile wimp worthless
abruti bouffon connard conne crétin débile imbécile ordure salaud salope stupide
arschloch blödmann dummkopf dumm idioten miststück schwachkopf trottel versager widerlich
asqueroso basura estúpido idiota imbécil inútil maldito patético payaso tonto
""".split()
COARSE = "bloody bullshit crap cunt damn fuck fucked fucker fucking piss prick shit shitty slut whore merde putain scheiße scheisse verdammt mierda puta joder".split()
THREATS = "attack beat burn hang hate hurt kill murder punch shoot stab strangle suffer tuer frapper töten umbringen hassen matar odiar".split()
SECOND = "you your yours yourself u ur ya tu toi vous votre dich dein ihr euch usted ustedes tú vosotros".split()

TRAIN_ROWS, PARTS = 40_000, 4
NEAR = 4
#: The learned list: lengths of word beginnings, least ratio of shares, least log-likelihood ratio (about one in a million
#: by chance), most entries.
STEMS, RATIO, EVIDENCE, ENTRIES = (4, 5, 6), 10.0, 24.0, 20_000
FEATURES = ["insults", "insult_words", "kinds", "coarse", "threats", "second_person", "near_second_person", "capitals", "shouted", "punctuation", "runs", "obfuscated", "obfuscated_words", "length", "learned", "learned_words", "learned_kinds", "learned_most"]

_LISTED = {**dict.fromkeys(THREATS, 2), **dict.fromkeys(COARSE, 1), **dict.fromkeys(INSULTS, 0), **dict.fromkeys(SECOND, 3)}
_WORDS = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\w)[^\W\d_]*(?:[0-9@$!|*]+[^\W\d_]+)+[0-9@$!|*]*|(?<!\w)[0-9@$!|]+[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){2,}[^\W\d_](?!\w)")
_RUNS = re.compile(r"[!?.*#$%&]{2,}")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_BY_LENGTH: dict[int, list[str]] = {}
for _w in _LISTED:
    if _LISTED[_w] < 3:
        _BY_LENGTH.setdefault(len(_w), []).append(_w)


def _obfuscated(text: str) -> int:
    """Listed words spelled with digits, signs or separators between their letters."""
    found = 0
    for m in _MASKED.finditer(text):
        word = m[0].translate(_LEET)
        if word in _LISTED or "*" in word and any(re.fullmatch(word.replace("*", r"\w"), w) for w in _BY_LENGTH.get(len(word), ())):
            found += 1
    return found + sum(re.sub(r"[.\-_*]", "", m[0]) in _LISTED for m in _SPACED.finditer(text))


def stems(text: str) -> set[str]:
    """A text's distinct words (closed by $) and word beginnings."""
    words = set(_WORDS.findall(text.lower()))
    return {w + "$" for w in words}.union(*({w[:n] for w in words if len(w) >= n} for n in STEMS))


#: What is known of a token (a text's parts between white space): sums over these columns, the largest of `most`.
COUNTED = ["words", "letters", "upper", "marks", "shouted", "runs", "hidden", "told", "told_weight", "most", "telling"]
#: Tokens are remembered up to this many, and none longer than this.
REMEMBERED, LONG = 200_000, 64


class Tokens(dict):
    """The number of each token's row in a table of what is known of it; every token is described once while remembered. Tokens
    that are one word on no list, nearly all, share one row for each length: a worker's memory then holds little but their names."""

    def __init__(self, learned: dict[str, float], remembered: int = REMEMBERED):
        super().__init__()
        self.learned, self.remembered = learned, remembered
        # a word that begins otherwise is on no list
        self.heads = {entry.rstrip("$")[:4] for entry in learned} | {w[:4] for w in _LISTED}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.table, self.new, self.filled = np.zeros((4096, len(COUNTED))), [], 0
        self.usual: dict[int, int] = {}  # the row of the usual tokens of each length
        self.telling: dict[int, tuple[list[tuple[int, int, str]], list[str]]] = {}  # listed words with their place and kind, learned words

    def weight(self, word: str) -> float:
        get = self.learned.get
        return max(get(word + "$", 0.0), *(get(word[:n], 0.0) for n in STEMS if len(word) >= n), 0.0)

    def describe(self, token: str) -> tuple[tuple[float, ...], list[tuple[int, int, str]], list[str]]:
        low = token.lower()
        words = _WORDS.findall(low)
        listed = [(i, _LISTED[w], w) for i, w in enumerate(words) if w in _LISTED]
        told = [(x, w) for w in words if (x := self.weight(w))]
        row = (
            len(words), sum(map(len, words)), sum(map(token.count, string.ascii_uppercase)), sum(map(token.count, "!?#$%&*")), sum(len(w) > 2 and w.isupper() for w in _WORDS.findall(token)),
            len(_RUNS.findall(token)), _obfuscated(low), len(told), sum(x for x, _ in told), max((x for x, _ in told), default=0.0), bool(listed or told),
        )
        return row, listed, [w for _, w in told]

    def __missing__(self, token: str) -> int:
        word = token[:-1] if token[-1] in ",.;:" else token
        number = self.filled + len(self.new)
        if word.isalpha() and word.islower() and word[:4] not in self.heads:  # the usual case: one word that is on no list
            number = self.usual.setdefault(len(word), number)
            if number == self.filled + len(self.new):
                self.new.append((1, len(word), 0, 0, 0, 0, 0, 0, 0, 0, 0))
        else:
            row, listed, told = self.describe(token)
            self.new.append(row)
            if listed or told:
                self.telling[number] = listed, told
        self[token] = number
        return number

    def rows(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of tokens and their rows."""
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            most = self.filled + len(self.new)
            while most > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.filled : most] = self.new
            self.new, self.filled = [], most
        return at, self.table[at]


def features(text: str | None, known: Tokens) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    tokens = text.split() if text else []
    if not tokens:
        return [0.0] * len(FEATURES)
    if len(known) > known.remembered:
        known.forget()
    sums, most, before = np.zeros(len(COUNTED)), 0.0, 0
    listed: list[tuple[int, int, str]] = []
    told: set[str] = set()
    for a in range(0, len(tokens), 100_000):
        part = tokens[a : a + 100_000]
        # too long to be remembered: described each time, its row is put in its place
        long = {i: known.describe(token) for i, token in enumerate(part) if len(token) > LONG} if max(map(len, part)) > LONG else {}
        at, rows = known.rows([t for t in part if len(t) <= LONG] if long else part)
        if long:
            where = np.fromiter(long, np.int64, len(long)) - np.arange(len(long))
            at, rows = np.insert(at, where, -1), np.insert(rows, where, [row for row, _, _ in long.values()], axis=0)
        sums += rows.sum(0)
        telling = np.flatnonzero(rows[:, -1])
        if len(telling):
            most = max(most, rows[telling, -2].max())
            begin = before + np.cumsum(rows[:, 0]) - rows[:, 0]
            for i in telling.tolist():
                here, kinds = long[i][1:] if i in long else known.telling[int(at[i])]
                listed += [(int(begin[i]) + place, k, w) for place, k, w in here]
                told.update(kinds)
        before += int(rows[:, 0].sum())
    words, letters, upper, marks, shouted, runs, hidden, n_told, weight, *_ = sums.tolist()
    n, size, letters = max(1.0, words), len(text), max(1.0, letters)
    hits = [[i for i, k, _ in listed if k == kind] for kind in range(4)]
    near, you = 0, np.sort(np.array(hits[3], np.int64))
    if len(you):
        rude = np.array(hits[0] + hits[1] + hits[2], np.int64)
        right = np.searchsorted(you, rude)
        near = int((np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - rude), np.abs(you[np.maximum(right - 1, 0)] - rude)) <= NEAR).sum())
    return [
        1000 * len(hits[0]) / n, len(hits[0]), len({w for _, k, w in listed if k < 3}), 1000 * len(hits[1]) / n, 1000 * len(hits[2]) / n, 1000 * len(hits[3]) / n, 1000 * near / n,
        100 * upper / letters, 100 * shouted / n, 100 * marks / size, 1000 * runs / n, 1000 * hidden / n, hidden, float(np.log1p(n)), 1000 * weight / n, n_told, len(told), most,
    ]


def described(rows: DataFrame, lists: dict[int, dict[str, float]], which: Column) -> DataFrame:
    """rows (with a text) and `features`; `which` names the list of learned words that describes a row."""
    sent = rows.sparkSession.sparkContext.broadcast(lists)  # ENTRIES at most each

    n_lists = len(lists)

    @F.arrow_udf("array<double>")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = {k: Tokens(v, REMEMBERED // n_lists) for k, v in sent.value.items()}
        for texts, names in batches:
            out = np.empty((len(texts), len(FEATURES)))  # a batch's texts become strings one at a time
            for i, (t, k) in enumerate(zip(texts, names)):
                out[i] = features(t.as_py(), known[k.as_py()])
            yield pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES), out.ravel())

    return rows.withColumn("features", extract("text", which))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def learn(train: DataFrame, parts: int) -> dict[int, dict[str, float]]:
    """For each part k the list learned on the other parts of the training texts (text, label, part): entry and weight."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = [(k, stem) for k in seen for stem in seen[k]]
            return pa.RecordBatch.from_arrays([pa.array([k // 2 for k, _ in keys], pa.int32()), pa.array([k % 2 for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.string()), pa.array([seen[k][s] for k, s in keys], pa.int64())], ["part", "label", "stem", "n"])

        seen: dict[int, Counter] = {}
        for batch in batches:
            for text, label, part in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "part"))):
                seen.setdefault(2 * part + int(label), Counter()).update(stems(text or ""))
                if sum(map(len, seen.values())) > 200_000:
                    yield out()
                    seen = {}
        if seen:
            yield out()

    sizes = train.groupBy("part", "label").count().collect()  # two rows for each part
    counts = train.select("text", "label", "part").mapInArrow(count, "part int, label int, stem string, n long")
    among = lambda label, k: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("part") != k), F.col("n"))), F.lit(0))
    sums = materialise(counts.groupBy("stem").agg(*[among(label, k).alias(f"{name}{k}") for k in range(parts) for label, name in ((1, "toxic"), (0, "clean"))]), "stems")
    out = {}
    for k in range(parts):
        bad, good = (sum(r["count"] for r in sizes if r["label"] == label and r["part"] != k) for label in (1.0, 0.0))
        toxic, clean = F.col(f"toxic{k}"), F.col(f"clean{k}")
        ratio = ((toxic + 0.2) / bad) / ((clean + 0.2) / good)
        rows, share = toxic + clean, bad / (bad + good)
        term = lambda n, p: F.when(n > 0, n * F.log(n / (rows * p))).otherwise(0.0)  # noqa: B023, E731
        evidence = 2 * (term(toxic, share) + term(clean, 1 - share))
        told = sums.filter((evidence >= EVIDENCE) & (ratio >= RATIO)).select("stem", F.log(ratio).alias("weight"))
        out[k] = {r.stem: r.weight for r in told.orderBy(F.desc("weight"), "stem").limit(ENTRIES).collect()}
    return out


class Scorer:
    """The fitted model; `scored` adds score and predicted to rows with a text."""

    def __init__(self, weights: dict[str, float], trees=None, calibration=None):
        self.weights, self.trees, self.calibration = weights, trees, calibration

    def scored(self, rows: DataFrame) -> DataFrame:
        rows = rows.drop("score", "predicted")
        # the columns of the input travel as one, so that none of the names used here can clash with them
        work = described(rows.select(F.struct("*").alias("row"), F.col("text").alias("text")), {0: self.weights}, F.lit(0)).drop("text")
        if self.trees is None:
            hits = F.get("features", F.lit(FEATURES.index("insult_words"))) + F.get("features", F.lit(FEATURES.index("obfuscated_words")))
            score = hits / (hits + 2)
        else:
            work = self.trees.transform(work.withColumn("vector", array_to_vector("features"))).withColumn("raw", vector_to_array("probability")[1])
            work = self.calibration.transform(work)
            # the calibration is a step-like map; a thousandth of the trees' own score keeps the order inside its steps
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("level") + 0.001 * F.col("raw")))
        return work.select("row.*", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_texts(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[DataFrame, int]:
    """(text, label, part): the distinct texts of the training rows, each class dealt evenly to the parts, and how many there are."""
    truth = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("label"))
    truth = materialise(truth.filter(fold(F.col("doc_id")) != 0), "labels")
    share = min(1.0, train_rows / max(1, truth.count()))
    chosen = truth.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about train_rows ids, so this broadcast is bounded by that parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = materialise(rows.groupBy(F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), (F.avg("label") >= 0.5).cast("double").alias("label")), "train")
    # an id can have many documents: the distinct texts are bounded as well, and with them all that is learned from or sent
    kept = min(1.0, train_rows / max(1, once.count()))
    if kept < 1:
        once = once.filter(F.pmod(F.xxhash64("hash", F.lit(2)), F.lit(1 << 30)) < int(kept * (1 << 30)))
    sizes = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = min(PARTS, sizes.get(0.0, 0), sizes.get(1.0, 0))
    if parts < 2:
        return once, 0
    # texts of a class follow each other in the numbers, so each class is dealt evenly
    numbered, _ = number_rows(once.select("hash", "label"), ["label", "hash"], "order", "place")
    dealt = numbered.select("hash", (F.col("place") % parts).alias("part"))
    return materialise(once.join(F.broadcast(dealt), "hash"), "parts"), parts


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """docs: doc_id and text; labels: doc_id and toxic."""
    train, parts = training_texts(docs, labels, train_rows)
    if not parts:
        return Scorer({})
    lists = learn(train, parts)
    known = materialise(described(train, lists, F.col("part")).select("label", "part", "features"), "features").withColumn("vector", array_to_vector("features"))
    learner = GBTClassifier(featuresCol="vector", labelCol="label", predictionCol="prediction", maxDepth=3, maxIter=20, stepSize=0.3, minInstancesPerNode=3, maxBins=64, seed=1)
    trees = learner.setRawPredictionCol("margin").setProbabilityCol("probability").fit(known.filter("part > 0"))
    held = trees.transform(known.filter("part = 0")).withColumn("raw", vector_to_array("probability")[1])
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="level").fit(held.select("raw", "label"))
    return Scorer(lists[0], trees, calibration)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return fit(docs, labels).scored(docs).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
