"""Toxicity by a weighted finite-state grammar.

Five transducers read the words of a clause, each word as a symbol: a function word (modal, addressee, negation, report), a
violent verb, an insult of one of LEVELS strengths, a verb that is also an insult, or any other. *threat* turns a modal,
a violent verb and an addressee into a threat; *insult* gives words their strength, and further insults of one phrase
count half; *negation* and *reported speech* turn what follows them into its negated or reported form; *target* raises what
stands near an addressee. Weights along a path multiply. The machines are composed once, and a clause's matched
patterns, not its words, have weights: a document is scored by its strongest clause, the sum over its clauses and their
number, with coefficients of no negative sign. So a negation or a report always lowers a score, and a target raises it.

Words get their insult strengths from labelled documents: arcs whose document frequencies differ between the classes beyond
chance get their log odds, on top of a small built-in lexicon; function words never become insults. A logistic
regression turns clause weights into a probability. At most TRAIN_ROWS documents of each class, of TRAIN_CHARS characters at
most and chosen by a hash of their ids, are fetched for this; everything else covers all documents and whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .forest import shingle_sets

#: Labelled documents of each class used for learning, and the longest ones that are: the only bounds on data here.
TRAIN_ROWS = 4_000
TRAIN_CHARS = 20_000
#: Arcs that the insult transducer keeps, by significance.
MOST_ARCS = 20_000
#: Bytes of the stems that may become arcs.
STEMS = (4, 5, 6, 8)
#: Least G-squared and least log odds of an arc.
LEAST_G2, LEAST_ODDS = 30.0, 2.5
PRIOR_WEIGHT = 3.0
#: Weight of a threat; clauses of less than COUNTED aren't counted as matched.
THREAT = 8.0
COUNTED = 2.0

LEXICON = {
    "I": "idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting clown clowns imbecile dumb filthy vermin "
    "dummkopf trottel abschaum versager widerlich wertlos schwachkopf crétin imbécile ordure connard débile minable idiota imbécil basura escoria asqueroso inútil patético",
    "V": "kill hurt destroy beat stab shoot burn strangle murder töten umbringen schlagen verletzen tuer frapper détruire brûler matar golpear destruir quemar",
    "M": "will gonna shall going werde wirst werden vais vas va allons voy vas vamos",
    "Y": "you your yours he him she her they them those these people dich dir du ihr euch sie tu toi te vous votre ils elles tú ti usted ustedes ellos ellas",
    "N": "not no never isn't aren't wasn't nicht kein keine nie pas jamais aucun nunca ni sin",
    "R": "said says wrote quoted quote reported called claims alleged sagte schrieb zitiert dit écrit cité dijo escribió citó",
}
#: Insult strengths: level k has weight LEVEL * k.
LEVELS, LEVEL = 12, 0.5
INSULTS = tuple(f"A{k}" for k in range(1, LEVELS + 1))
#: What the first machine reads: other words, function words, violent verbs, insults, verbs that are insults as well.
ALPHABET = ("o", "M", "Y", "N", "R", "V", *INSULTS, *(f"V{a}" for a in INSULTS))
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;\n"]] = True
FEATURES = ("strongest", "total", "clauses")
#: Intercept and coefficients where there are no labels of both classes.
FIXED = np.array([-4.0, 0.5, 1.0, 0.5])
#: What the composed machine writes for a matched pattern: a plain, negated, reported or targeted insult or threat.
MATCHED = ("I", "J", "K", "y", "T", "U", "W", "t")


# --- the machines ------------------------------------------------------------------------------


class Fst:
    """A deterministic weighted transducer: state -> label -> (state, label, weight). State 0 is the start; all states accept."""

    def __init__(self, arcs: dict[int, dict[str, tuple[int, str, float]]]):
        self.arcs = arcs

    def compose(self, other: Fst) -> Fst:
        """First this machine, then ``other`` on what it writes; weights multiply. Only states that are reached are made."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = todo.pop()
            own = arcs[number[a, b]] = {}
            for label, (a2, out, w) in self.arcs[a].items():
                b2, out2, w2 = other.arcs[b][out]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                own[label] = (number[a2, b2], out2, w * w2)
        return Fst(arcs)

    def walk(self, labels: list[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for x in labels:
            state, y, w = self.arcs[state][x]
            out.append((y, w))
        return out


def machine(labels: tuple[str, ...], fade: dict, special: dict) -> Fst:
    """A machine over ``labels`` that passes them unchanged unless ``special`` {(state, label): (state, label, weight)} says otherwise.

    ``fade``: the state after any other word in each state.
    """
    number = {s: i for i, s in enumerate(fade)}
    arcs = {i: {x: (number[fade[s]], x, 1.0) for x in labels} for s, i in number.items()}
    for (s, x), (after, y, w) in special.items():
        arcs[number[s]][x] = (number[after], y, w)
    return Fst(arcs)


def _ages(kind: str, reach: int) -> dict:
    """A state that holds for ``reach`` more words."""
    return {(kind, i): (kind, i + 1) if i + 1 < reach else "" for i in range(reach)}


def threat_machine() -> Fst:
    """A modal, a violent verb and an addressee, each within five words of the one before, make a threat; verbs alone are plain words."""
    fade = {"": ""} | _ages("modal", 5) | _ages("verb", 5)
    special: dict = {}
    for s in fade:
        kind = s[0] if s else ""
        special[s, "M"] = (("modal", 0), "M", 1.0)
        if kind == "verb":
            special[s, "Y"] = ("", "T", 1.0)
        for verb, alone in [("V", "o"), *((f"V{a}", a) for a in INSULTS)]:
            special[s, verb] = (("verb", 0) if kind == "modal" else fade[s], alone, 1.0)
    return machine(ALPHABET, fade, special)


def insult_machine() -> Fst:
    """Insults of each strength get their weight and threats theirs; within two words of another insult they count half."""
    fade = {"": ""} | _ages("phrase", 2)
    special: dict = {}
    for s in fade:
        for k, a in enumerate(INSULTS, 1):
            special[s, a] = (("phrase", 0), "I", LEVEL * k * (0.5 if s else 1.0))
        special[s, "T"] = ("", "T", THREAT)
    return machine(("o", "M", "Y", "N", "R", *INSULTS, "T"), fade, special)


def negation_machine() -> Fst:
    """A negation with at most two words between makes an insult J and a threat U, of a tenth of the weight."""
    fade = {"": ""} | _ages("not", 3)
    special: dict = {(s, "N"): (("not", 0), "N", 1.0) for s in fade}
    special |= {(s, x): ("", y, 0.1) for s in fade if s for x, y in (("I", "J"), ("T", "U"))}
    return machine(("o", "M", "Y", "N", "R", "I", "T"), fade, special)


def report_machine() -> Fst:
    """After a verb of report the rest of the clause is what others said: insults become K and threats W, of three tenths of the weight."""
    fade = {"": "", "said": "said"}
    special: dict = {(s, "R"): ("said", "R", 1.0) for s in fade}
    special |= {("said", x): ("said", y, 0.3) for x, y in (("I", "K"), ("T", "W"))}
    return machine(("o", "M", "Y", "N", "R", "I", "T", "J", "U"), fade, special)


def target_machine() -> Fst:
    """An insult or a threat within five words after an addressee weighs half as much again."""
    reach = 5
    fade = {"": ""} | _ages("target", reach)
    special: dict = {(s, "Y"): (("target", 0), "Y", 1.0) for s in fade}
    special |= {(s, x): (s, y, 1.5) for s in fade if s for x, y in (("I", "y"), ("T", "t"))}
    return machine(("o", "M", "Y", "N", "R", "I", "T", "J", "U", "K", "W"), fade, special)


def grammar() -> Fst:
    """The five machines, composed."""
    out = threat_machine()
    for more in (insult_machine(), negation_machine(), report_machine(), target_machine()):
        out = out.compose(more)
    return out


# --- learning ----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _spread(texts: list[str], labels: list[int]) -> tuple[list[str], list[int]]:
    """Without copies and near copies of earlier texts, whose words would count again and again."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i in range(0, len(texts), 200):
        for x, s in enumerate(shingle_sets(common.Words(*_bytes(texts[i : i + 200])), 3), i):
            marks = {(k, int((s * m).min())) for k, m in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)))} if len(s) else {(9, 0)}
            if not marks & seen:
                kept.append(x)
            seen |= marks
    return [texts[x] for x in kept], [labels[x] for x in kept]


def learn_arcs(texts: list[str], labels: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{stem bytes, or 0 for whole words: (sorted hashes, weights)} of the insult transducer."""
    found: dict[int, list] = defaultdict(list)
    for i in range(0, len(texts), 200):
        w = common.Words(*_bytes(texts[i : i + 200]), common.NOT_ALNUM)
        for c in (0, *STEMS):
            wide = w.end - w.start > c if c else np.ones(len(w.start), bool)
            h = w.span_hash(w.start[wide], w.start[wide] + c) if c else w.hash
            doc = np.searchsorted(w.doc, np.flatnonzero(wide), "right") - 1
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
            found[c].append((h[new], np.array(labels, np.int64)[i + doc[new]]))
    n1 = sum(labels)
    n0 = len(labels) - n1
    arcs = {}
    function_words = common.hash_of(" ".join(LEXICON[x] for x in "MYNR").split())
    for c in (0, *STEMS):
        h = np.concatenate([x for x, _ in found[c]]) if found[c] else np.zeros(0, np.uint64)
        y = np.concatenate([x for _, x in found[c]]) if found[c] else np.zeros(0, np.int64)
        known, at = np.unique(h, return_inverse=True)
        a = np.bincount(at, y, len(known))
        b = np.bincount(at, 1 - y, len(known))
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        e = (a + b) * n1 / max(1, n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(a > 0, a * np.log(a / e), 0) + np.where(b > 0, b * np.log(b / (a + b - e)), 0))
        good = np.flatnonzero((odds >= LEAST_ODDS) & (g2 >= LEAST_G2) & ~np.isin(known, function_words))
        good = np.sort(good[np.argsort(-g2[good], kind="stable")][:MOST_ARCS])
        hashes, weights = known[good], odds[good]
        if c == 0:  # built-in arcs, unless the documents speak against them
            prior = np.unique(common.hash_of(LEXICON["I"].split()))
            where = np.searchsorted(known, prior)
            there = (where < len(known)) & (known[np.minimum(where, max(0, len(known) - 1))] == prior) if len(known) else np.zeros(len(prior), bool)
            against = np.zeros(len(prior), bool)
            against[there] = (odds[where[there]] < 1) & (b[where[there]] >= 5)
            more = prior[~against & ~np.isin(prior, hashes)]
            hashes, weights = np.r_[hashes, more], np.r_[weights, np.full(len(more), PRIOR_WEIGHT)]
            order = np.argsort(hashes)
            hashes, weights = hashes[order], weights[order]
        if len(hashes):
            arcs[c] = (hashes, weights)
    return arcs


class Scorer:
    """Features and scores of texts, given the learned arcs and coefficients."""

    def __init__(self, arcs: dict[int, tuple[np.ndarray, np.ndarray]], coefficients: np.ndarray | None = None):
        self.arcs, self.coefficients = arcs, coefficients
        self.machine = grammar()
        self.fixed = {x: np.sort(common.hash_of(LEXICON[x].split())) for x in "VMYNR"}
        self.bits = {c: self._bitmap(h) for c, (h, _) in arcs.items()}
        self.verbs = self._bitmap(self.fixed["V"])

    @staticmethod
    def _bitmap(h: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(h >> np.uint64(44)).astype(np.int64)] = True
        return out

    def features(self, w: common.Words, data: np.ndarray) -> np.ndarray:
        """(texts, FEATURES), zeros where no clause holds a marked word."""
        weight = np.zeros(len(w.hash))
        for c, (known, value) in self.arcs.items():
            if c:
                wide = np.flatnonzero(w.end - w.start > c)
                h = w.span_hash(w.start[wide], w.start[wide] + c)
            else:
                wide, h = np.arange(len(w.hash)), w.hash
            may = np.flatnonzero(self.bits[c][(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[may]), len(known) - 1)
            hit = known[at] == h[may]
            where = wide[may[hit]]
            weight[where] = np.maximum(weight[where], value[at[hit]])
        verb = self.verbs[(w.hash >> np.uint64(44)).astype(np.int64)]
        verb[verb] = np.isin(w.hash[verb], self.fixed["V"])
        out = np.zeros((len(w.doc) - 1, len(FEATURES)))
        marked = np.flatnonzero((weight > 0) | verb)
        texts = np.searchsorted(w.doc, marked, "right") - 1
        level = np.clip(np.rint(weight / LEVEL), 1, LEVELS).astype(np.int64) * (weight > 0)
        for t in np.unique(texts).tolist():
            lo, hi = int(w.doc[t]), int(w.doc[t + 1])
            begin = w.start[lo:hi]
            ends = begin[0] + np.flatnonzero(_BREAK[data[begin[0] : w.end[hi - 1]]])
            clause = np.searchsorted(ends, begin)
            own = marked[texts == t] - lo
            wanted = np.unique(clause[own])
            for a, b in zip(np.searchsorted(clause, wanted).tolist(), np.searchsorted(clause, wanted, "right").tolist(), strict=True):
                value = self.clause(self.symbols(w.hash[lo + a : lo + b], level[lo + a : lo + b]))
                out[t, 0] = max(out[t, 0], value)
                out[t, 1] += value
                out[t, 2] += value >= COUNTED
        out[:, 1:] = np.log1p(out[:, 1:])
        return out

    def symbols(self, h: np.ndarray, level: np.ndarray) -> list[str]:
        """What the machine reads for a clause's words. Function words come before insults; verbs that are insults keep both readings."""
        labels = [f"A{k}" if k else "o" for k in level.tolist()]
        for x in "VRNYM":
            for i in np.flatnonzero(np.isin(h, self.fixed[x])).tolist():
                labels[i] = f"V{labels[i]}" if x == "V" and level[i] else x
        return labels

    def clause(self, labels: list[str]) -> float:
        """Sum of the weights of a clause's matched patterns."""
        return sum(w for y, w in self.machine.walk(labels) if y in MATCHED)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(features @ self.coefficients[1:] + self.coefficients[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> np.ndarray:
    """Intercept and coefficients of no negative sign, by Newton's method with a quadratic penalty on the latter.

    A coefficient that would turn negative is held at zero, the worst first, and the others are fitted again.
    """
    one = np.c_[np.ones(len(x)), x]
    free = list(range(one.shape[1]))
    while True:
        part, beta = one[:, free], np.zeros(len(free))
        ridge = np.diag([1e-6] + [penalty] * (len(free) - 1))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(part @ beta, -30, 30)))
            step = np.linalg.solve(part.T @ (part * (p * (1 - p))[:, None]) + ridge, part.T @ (y - p) - ridge @ beta)
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if len(free) == 1 or beta[1:].min() >= 0:
            out = np.zeros(one.shape[1])
            out[free] = beta
            return out
        free.pop(1 + int(beta[1:].argmin()))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    """Learn from labelled documents outside the held-out fifth, at most ``rows`` of each class.

    Without labelled documents the built-in lexicon and fixed coefficients are used.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    known = common.cut(known)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    chosen = None
    for c in (0, 1):
        # Four times what is needed lies below this bound, so that tasks send about 4 * rows ids, however many tasks there are.
        bound = int(2**53 * min(1.0, 4 * rows / max(1, counts.get(c, 0))))
        part = known.where((F.col("toxic") == c) & (place < bound)).orderBy(place, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = F.broadcast(chosen)  # at most 2 * rows rows of two numbers
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").where(F.length("text") <= TRAIN_CHARS).join(picked, "doc_id").collect()
    rows_ = sorted(rows_, key=lambda r: (r.doc_id, r.toxic, r.text))
    texts, y = _spread([r.text for r in rows_], [r.toxic for r in rows_])
    scorer = Scorer(learn_arcs(texts, y))
    if not 0 < sum(y) < len(y):
        scorer.coefficients = FIXED.copy()
        return scorer
    parts = []
    for i in range(0, len(texts), 200):
        data, offsets = _bytes(texts[i : i + 200])
        parts.append(scorer.features(common.Words(data, offsets, common.NOT_ALNUM), data))
    scorer.coefficients = fit_logistic(np.concatenate(parts), np.array(y, float))
    return scorer


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, clause_weight) of every row of ``docs`` (doc_id, text); null and empty texts get the score of no clause."""
    common.bounded_batches(common.session(docs))

    def run(batches: Iterator[pa.RecordBatch], arcs=scorer.arcs, coefficients=scorer.coefficients) -> Iterator[pa.RecordBatch]:
        own = Scorer(arcs, coefficients)
        for batch in batches:
            parts = [np.zeros((0, len(FEATURES)))]
            for _, _, data, offsets in common.text_slices(batch.column(1)):
                parts.append(own.features(common.Words(data, offsets, common.NOT_ALNUM), data))
            f = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(f)), pa.array(f[:, 0])], names=["doc_id", "score", "clause_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, clause_weight double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest: doc_id, held_out, score, predicted; one row per row of ``docs``, whatever the labels cover."""
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clause_weight")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns and their order stay."""
    scorer = train(docs, labels)

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(scorer.arcs, scorer.coefficients)
        for s in texts:
            parts = [np.zeros((0, len(FEATURES)))]
            for _, _, data, offsets in common.text_slices(pa.array(s, pa.large_string(), from_pandas=True)):
                parts.append(own.features(common.Words(data, offsets, common.NOT_ALNUM), data))
            yield pd.Series(own.score(np.concatenate(parts)))

    common.bounded_batches(common.session(docs))
    return docs.where(toxic(F.col("text").cast("string")) < 0.5)
