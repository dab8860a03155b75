"""Toxicity by a weighted finite-state pattern grammar.

Words are read by a lexicon that gives them a class and a weight: insult, threat, target, negation, reported speech, a quotation
mark, or the end of a clause. Four transducers over classes are composed into one machine, state by state:

* negation rewrites an insult or threat within NEAR words after a negation to a negated one,
* reported speech rewrites what a reporting word or an open quotation mark governs, up to the end of its sentence or quotation,
* target raises an insult or threat of a clause whose target came within NEAR words before it,
* the patterns give what is left its factor.

What a clause scores is the sum, over its insults and threats, of the word's weight times the factor of its path; words outside
such a pattern score nothing, whatever else they are. The lexicon's hand-written part gives classes and starting weights. Insults
are learned as well: words and beginnings of words whose rate among distinct surroundings (the word with its two neighbours) in
toxic training rows is a multiple of that in the others, so that copies and near copies of a text count once. A logistic
regression over each document's clause scores and length, fitted by Newton steps over all labelled training rows (sums of at most
D * D numbers reach the driver), turns them into a probability.

Parameters that bound what reaches the driver and the tasks: at most MAX_PATTERNS learned beginnings and whole words.

Defined results: a null or empty text has no clause and gets the prior's score by its length; documents without a label, null labels
and null ids don't train; of several labels of one document each counts; without training rows of both classes the hand-written
lexicon scores alone, by fixed coefficients; a very long text is read word by word; repeated rows score alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, small_side, written

THRESHOLD, FOLDS = 0.5, 5
#: Words between a negation or a target and what it governs.
NEAR = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, COMMA, END = range(9)
#: What the rewriting transducers make of insults and threats: bits of one mark.
NEGATED, REPORTED, TARGETED = 1, 2, 4

# The hand-written lexicon: words of everyday use in the corpus' languages.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown fool dumb imbecile vermin filth garbage idiota estúpido imbécil basura asqueroso payaso crétin débile ordure minable dégoûtant dumm trottel abschaum widerlich wertlos"
THREATS = "kill hurt destroy beat punish burn matar destruir golpear quemar tuer détruire frapper brûler töten vernichten schlagen verbrennen"
TARGETS = "you your yourself he she they them him tú usted ustedes ellos tu toi vous ils elles du dich ihr euch"
NEGATIONS = "not never no isn't aren't wasn't don't didn't nunca jamais nicht nie kein keine"
REPORTS = "said says told claimed wrote called quoted dijo dice llamó dit disait appelé sagte sagt nannte"
START_WEIGHT = {INSULT: 4.0, THREAT: 1.0}
#: Factors of what is left after the rewriting transducers.
FACTOR = {0: 1.0, NEGATED: 0.5, REPORTED: 0.5, TARGETED: 1.25, NEGATED | REPORTED: 0.25, NEGATED | TARGETED: 0.5, REPORTED | TARGETED: 0.5, NEGATED | REPORTED | TARGETED: 0.25}
#: Learned beginnings: their lengths, the least distinct surroundings in toxic rows, the least rate ratio, the least gain, how many.
LENGTHS, LEAST, RATIO, GAIN, MAX_PATTERNS = range(3, 13), 4, 4.0, 14.0, 4000
SMOOTH = 0.5
#: The share of a beginning's toxic surroundings at which a longer one takes its place.
SPECIFIC = 0.9
#: Words of one task that are counted before they are handed on.
HELD = 200_000
STEPS, RIDGE = 12, 0.05
#: Of the features below, used where no labels teach.
PLAIN = (-3.0, 1.6, 0.0, 1.0, 0.0, 0.0, 0.0)
FEATURES = ("constant", "log_score", "log_words", "log_density", "log_worst", "clause_share", "softened_share")

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?\n]|[,;:]|[\"“”«»]")


# --- transducers -----------------------------------------------------------------------------------------------------------
# A transducer is (start, step): step(state, symbol) gives the next state and the symbol it writes. A symbol is (class, mark).


def negation(near: int = NEAR):
    """State: how many words a negation still reaches."""

    def step(left, symbol):
        kind, mark = symbol
        if kind == NEGATION:
            return near, symbol
        if kind in (COMMA, END):
            return 0, symbol
        if kind in (INSULT, THREAT) and left:
            return left - 1, (kind, mark | NEGATED)
        return max(0, left - 1), symbol

    return 0, step


def reported_speech():
    """State: 0 plain, 1 after a reporting word up to the sentence's end, 2 inside quotation marks."""

    def step(state, symbol):
        kind, mark = symbol
        if kind == QUOTE:
            return (0 if state == 2 else 2), symbol
        if kind == END:
            return (2 if state == 2 else 0), symbol
        if kind == REPORT and not state:
            return 1, symbol
        if kind in (INSULT, THREAT) and state:
            return state, (kind, mark | REPORTED)
        return state, symbol

    return 0, step


def target(near: int = NEAR):
    """State: how many words a target still reaches."""

    def step(left, symbol):
        kind, mark = symbol
        if kind == TARGET:
            return near, symbol
        if kind in (COMMA, END):
            return 0, symbol
        if kind in (INSULT, THREAT) and left:
            return left - 1, (kind, mark | TARGETED)
        return max(0, left - 1), symbol

    return 0, step


def patterns():
    """The last transducer writes factors: of an insult, and of a threat that names a target."""

    def step(state, symbol):
        kind, mark = symbol
        if kind == INSULT:
            return 0, FACTOR[mark]
        if kind == THREAT:
            return 0, FACTOR[mark] if mark & TARGETED else 0.0
        return 0, 0.0

    return 0, step


def composed(*machines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next states, factors and marks of the composition, by (state, class); only states that can be reached."""
    starts, steps = zip(*machines, strict=True)
    numbers, todo, rows = {starts: 0}, [starts], []
    while todo:
        state, row = todo.pop(0), []
        for kind in range(END + 1):
            then, symbol, mark = [], (kind, 0), 0
            for q, step in zip(state, steps, strict=True):
                q, symbol = step(q, symbol)
                then.append(q)
                mark = symbol[1] if isinstance(symbol, tuple) else mark
            if tuple(then) not in numbers:
                numbers[tuple(then)] = len(numbers)
                todo.append(tuple(then))
            row.append((numbers[tuple(then)], symbol, mark))
        rows.append(row)
    return tuple(np.array([[x[k] for x in row] for row in rows], kind) for k, kind in ((0, np.int64), (1, float), (2, np.int64)))


def machine() -> tuple[list[list[int]], list[list[float]], list[list[int]]]:
    return tuple(x.tolist() for x in composed(negation(), reported_speech(), target(), patterns()))


# --- lexicon ---------------------------------------------------------------------------------------------------------------


def hand_written() -> dict[str, tuple[int, float]]:
    out: dict[str, tuple[int, float]] = {x: (COMMA, 0.0) for x in ",;:"} | {x: (END, 0.0) for x in ".!?\n"} | {x: (QUOTE, 0.0) for x in '"“”«»'}
    for kind, said in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
        out |= {w: (kind, START_WEIGHT.get(kind, 0.0)) for w in said.split()}
    return out


class Lexicon:
    """Classes and weights of words: hand-written words, learned whole words, then the longest learned beginning."""

    def __init__(self, learned: dict[str, float], remembered: int = HELD):
        self.known, self.remembered = hand_written(), remembered
        self.whole = {k[:-1]: v for k, v in learned.items() if k.endswith("$")}
        self.begins = {k: v for k, v in learned.items() if not k.endswith("$")}
        self.lengths = sorted({len(k) for k in self.begins}, reverse=True)
        self.seen: dict[str, tuple[int, float]] = {}

    def find(self, word: str) -> tuple[int, float]:
        """word in lower case."""
        kind, weight = self.known.get(word, (OTHER, 0.0))
        if word in self.whole:
            weight = self.whole[word]
        elif kind == OTHER:
            weight = next((self.begins[word[:n]] for n in self.lengths if word[:n] in self.begins), 0.0)
        return (INSULT if kind == OTHER and weight > 0 else kind), weight

    def __call__(self, token: str) -> tuple[int, float]:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) >= self.remembered:
                self.seen.clear()
            found = self.seen[token] = self.find(token.lower())
        return found


def clauses(text: str | None, lexicon: Lexicon, grammar) -> tuple[int, int, list[tuple[float, float]]]:
    """Words, clauses, and (score, softened score) of each clause that scores; softened is what negated or reported patterns gave."""
    then, factors, marks = grammar
    state, words, ends, score, softened, pending, out = 0, 0, 0, 0.0, 0.0, False, []
    for token in WORD.findall(text or ""):
        kind, weight = lexicon(token)
        if kind in (COMMA, END):
            if pending:
                ends += 1
                if score:
                    out.append((score, softened))
                score, softened, pending = 0.0, 0.0, False
        elif kind != QUOTE:
            words += 1
            pending = True
        if weight and (factor := factors[state][kind]):
            score += weight * factor
            if marks[state][kind] & (NEGATED | REPORTED):
                softened += weight * factor
        state = then[state][kind]
    if pending:
        ends += 1
        if score:
            out.append((score, softened))
    return words, ends, out


def features(text: str | None, lexicon: Lexicon, grammar) -> list[float]:
    words, ends, found = clauses(text, lexicon, grammar)
    total = sum(x for x, _ in found)
    return [1.0, math.log1p(total), math.log1p(words), math.log1p(100 * total / max(1, words)), math.log1p(max((x for x, _ in found), default=0.0)), len(found) / max(1, ends), sum(y for _, y in found) / total if total else 0.0]


# --- learning --------------------------------------------------------------------------------------------------------------


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's labelled texts: words by class, each with its occurrences and texts, and the words in all."""
    found: Counter = Counter()

    def out():
        rows = pd.DataFrame([(w, y, n) for (w, y), n in found.items()], columns=["word", "label", "n"])
        found.clear()
        return rows

    for part in parts:
        for text, label in zip(part["text"], part["label"], strict=True):
            found.update((w, label) for w in (x.lower() for x in WORD.findall(text or "")) if w[0].isalnum())
            if len(found) > HELD:
                yield out()
    yield out()


def _by_beginning(counts: DataFrame) -> DataFrame:
    """(pattern, word counts summed): each word under its beginnings and, marked by $, as a whole."""
    lengths = F.array(*[F.lit(n) for n in LENGTHS])
    begins = F.transform(F.filter(lengths, lambda n: n <= F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))
    return counts.withColumn("pattern", F.explode(F.concat(begins, F.array(F.concat("word", F.lit("$"))))))


def _gain(c1, c0, n1: float, n0: float):
    """Twice the log-likelihood ratio of two rates, as a column."""
    part = lambda c, n, rate: F.when(c > 0, c * F.log(c / (n * rate))).otherwise(0.0)
    rate = (c1 + c0) / (n1 + n0)
    return 2 * (part(c1, n1, rate) + part(c0, n0, rate))


def _surroundings(parts: Iterator[pd.DataFrame], candidates: frozenset[str]) -> Iterator[pd.DataFrame]:
    """(pattern, label, h): the hash of a candidate's word with its neighbours, once a text."""
    lengths = sorted({len(x) for x in candidates if not x.endswith("$")})
    known: dict[str, list[str]] = {}
    for part in parts:
        rows: set[tuple[str, int, int]] = set()
        for text, label in zip(part["text"], part["label"], strict=True):
            words = [w for w in (x.lower() for x in WORD.findall(text or "")) if w[0].isalnum()]
            for i, w in enumerate(words):
                hits = known.get(w)
                if hits is None:
                    if len(known) >= HELD:
                        known.clear()
                    hits = known[w] = [w[:n] for n in lengths if n <= len(w) and w[:n] in candidates] + ([w + "$"] if w + "$" in candidates else [])
                if hits:
                    rows.update((p, label, around) for around in (" ".join(words[max(0, i - 1) : i + 2]),) for p in hits)
            if len(rows) > HELD:
                yield pd.DataFrame(rows, columns=["pattern", "label", "around"])
                rows.clear()
        yield pd.DataFrame(rows, columns=["pattern", "label", "around"])


def learn_patterns(labelled: DataFrame) -> dict[str, float]:
    """Weights of learned beginnings and whole words (marked by $) from (text, label) rows."""
    counts = written(labelled.mapInPandas(releasing(_counted), "word string, label int, n long").groupBy("word", "label").agg(F.sum("n").alias("n")), "toxicity-words")
    total = {r["label"]: float(r["n"]) for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = total.get(1, 0.0), total.get(0, 0.0)
    if not n1 or not n0:
        return {}
    c1, c0 = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c0")
    summed = _by_beginning(counts).groupBy("pattern").agg(c1, c0)
    likely = (F.col("c1") >= LEAST) & (((F.col("c1") + SMOOTH) / n1) >= RATIO * ((F.col("c0") + SMOOTH) / n0)) & (_gain(F.col("c1"), F.col("c0"), n1, n0) >= GAIN)
    rows = summed.where(likely).orderBy(F.desc(_gain(F.col("c1"), F.col("c0"), n1, n0)), "pattern").limit(MAX_PATTERNS).select("pattern").collect()
    candidates = frozenset(r["pattern"] for r in rows)
    if not candidates:
        return {}
    # Second look, at distinct surroundings: copies of a text, repeated lines and passages count once.
    seen = labelled.mapInPandas(lambda parts: releasing(lambda p: _surroundings(p, candidates))(parts), "pattern string, label int, around string")
    distinct = seen.groupBy("pattern", "label", F.xxhash64("around").alias("h")).count().groupBy("pattern").agg(
        F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0")).collect()
    found = {r["pattern"]: (r["c1"], r["c0"]) for r in distinct}
    return chosen(found, n1, n0)


def chosen(found: dict[str, tuple[int, int]], n1: float, n0: float) -> dict[str, float]:
    """The patterns whose rate is a multiple, each with the logarithm of the ratio.

    A beginning gives way to a longer one, or to the whole word, with nearly all of its toxic surroundings; a longer one that adds
    little to a shorter one is left out."""

    def weight(c):
        return math.log(((c[0] + SMOOTH) / n1) / ((c[1] + SMOOTH) / n0))

    longer: Counter = Counter()
    for q, (c, _) in found.items():
        for n in range(LENGTHS[0], len(q)):
            longer[q[:n]] = max(longer[q[:n]], c)
    out: dict[str, float] = {}
    for p in sorted(found, key=lambda x: (len(x.rstrip("$")), x.endswith("$"), x)):
        c = found[p]
        w = weight(c)
        if c[0] < LEAST or w < math.log(RATIO) or longer[p] >= SPECIFIC * c[0]:
            continue
        shorter = next((out[p[:n]] for n in range(len(p) - 1, LENGTHS[0] - 1, -1) if p[:n] in out), 0.0)
        if w > shorter + 0.5:
            out[p] = w
    return out


def _sums(parts: Iterator[pd.DataFrame], w: np.ndarray) -> Iterator[pd.DataFrame]:
    d = len(w)
    total = np.zeros(d * d + d + 1)
    for part in parts:
        if len(part):
            x, y = np.stack(part["x"].to_numpy()), part["label"].to_numpy(float)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            total[: d * d] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
            total[d * d : -1] += x.T @ (y - p)
            total[-1] += len(part)
    yield pd.DataFrame({"k": np.arange(len(total)), "v": total})


def fit(rows: DataFrame) -> np.ndarray:
    """Coefficients of a ridge logistic regression over rows (x, label), by Newton steps; equal rows count once."""
    d = len(FEATURES)
    w = np.zeros(d)
    for _ in range(STEPS):
        summed = {r["k"]: r["v"] for r in rows.mapInPandas(lambda parts, w=w: _sums(parts, w), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        s = np.array([summed.get(k, 0.0) for k in range(d * d + d)])
        step = np.linalg.solve(s[: d * d].reshape(d, d) + RIDGE * np.eye(d), s[d * d :] - RIDGE * w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """The learned patterns and the coefficients, from the labelled rows that ``training`` (a predicate on the id) lets train."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(training(F.col("id")))
    labelled = written(texts.join(small_side(known), "id").select("text", "label"), "toxicity-labelled")
    learned = learn_patterns(labelled)
    rows = written(labelled.select(document_features(learned)("text").alias("x"), "label").distinct(), "toxicity-features")
    both = rows.agg(F.count_distinct("label").alias("n")).first()["n"] == 2
    return learned, fit(rows) if both else np.array(PLAIN)


def document_features(learned: dict[str, float]):
    """A column function from text to FEATURES."""

    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, grammar = Lexicon(learned), machine()
        for texts in parts:
            yield pd.Series([features(x, lexicon, grammar) for x in texts])

    return F.pandas_udf(releasing(read), "array<double>")


def score(docs: DataFrame, learned: dict[str, float], w: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, x): the probability and the features it was taken from."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), document_features(learned)(F.col(f"`{text_col}`").cast("string")).alias("x"))
    z = sum((F.col("x")[i] * float(c) for i, c in enumerate(w)), F.lit(0.0))
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "x")


def classify(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, score, x) of every row of docs."""
    return score(docs, *train(docs, labels, training, id_col, text_col, label_col), id_col, text_col)
