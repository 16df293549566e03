"""Toxicity by a lexicon that tolerates misspelling, with context windows.

The lexicon is a trie. A Levenshtein automaton of every term, the trie's shared prefixes and the text's letters are followed
together: a state is a set of (trie node, edits so far), sets are numbered as they come up, and a word is dropped at the first
letter after which no term is within its budget. Digits and signs that stand for letters are read as those. Besides terms the
trie has stems, written with a star: any word that begins with one, without edits, is a hit. A word within a term's edits that
clean texts use is a word of its own and no misspelling.

Each hit is judged in a window of its text, which gives it a likelihood of being quotation: marks around it and words that
report speech raise it, words that address somebody lower it. A hit counts as abuse by the rest. A logistic model of exact,
misspelled and stem abuse and of quotation gives the score; its prior says what hits mean where labels don't tell. Terms, stems,
clean words and weights are learned from a bounded sample of labelled rows: about ``sample`` of them, by a hash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that the lexicon has before it learns.
SEED_TERMS = "idiot idiotic stupid moron moronic loser pathetic disgusting worthless trash scum clown imbecile dumbass jackass bastard bitch asshole fucker retard scumbag dimwit".split()
#: Words near a term that tell of speech rather than being it.
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes word words term slur insult insults insulting offensive reported described so-called mean means meaning".split())
#: Words near a term that address somebody.
ADDRESS = frozenset("you your you're youre u ur yourself".split())
#: Signs and digits read as letters.
LOOKALIKES = str.maketrans("013457@$!+", "oieastasit")
_TOKEN = re.compile(r"[@$\d]*[^\W\d_](?:[\w@$!*+]*[^\W_])?")
_QUOTES = "\"“”„«»"
#: Characters on each side of a hit in which marks and words are looked for, and words on each side.
WINDOW, NEAR = 60, 5
#: Log-odds of quotation: at first, for marks around a hit, for each reporting word (two at most), for an addressing word.
QUOTATION = (-3.0, 5.0, 2.5, -1.5)
#: Share of learned terms that may be chance, and how many times likelier a term must be in toxic texts.
FALSE_TERMS, LIFT = 0.05, 10.0
#: Log-odds of a term of full strength, and parts of the labelled texts of which each is held out once to fit weights.
FULL, FOLDS = 4.0, 2
#: Least word hashes by which near copies are known in the sample.
SKETCH = 8
#: Letters of a stem.
STEM = range(4, 9)
#: Numbered states at most; beyond it they are numbered anew.
MAX_STATES = 100_000


def budget(term: str) -> int:
    """Edits that a term tolerates; stems none."""
    return 0 if len(term) < 4 or term.endswith("*") else 1 if len(term) < 10 else 2


class FuzzyLexicon:
    """``find(word)`` -> (edits, term) of the nearest term within its budget, or None; ``clean`` words are hits only if they are terms."""

    def __init__(self, terms, clean=(), edits: bool = True):
        self.clean, self.edits = frozenset(clean), edits
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room = [0]  # the largest budget of the terms below a node
        for t in sorted(set(terms)):
            at = 0
            self.room[0] = max(self.room[0], self.allowed(t))
            for ch in t.rstrip("*"):
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.room.append(0)
                at = self.children[at][ch]
                self.room[at] = max(self.room[at], self.allowed(t))
            (self.stem if t.endswith("*") else self.term)[at] = t
        self.letters = {ch for c in self.children for ch in c}
        self._restart()

    def allowed(self, term: str) -> int:
        return budget(term) if self.edits else 0

    def _restart(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.stems: list[str | None] = []
        self.begin = self._number(self._closed({0: 0}))

    def _closed(self, least: dict[int, int]) -> frozenset:
        """With the nodes that are reached by leaving letters out of the text."""
        todo = list(least)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = least[node] + 1
                if edits <= self.room[child] and edits < least.get(child, 99):
                    least[child] = edits
                    todo.append(child)
        return frozenset(least.items())

    def _number(self, state: frozenset) -> int:
        """-1 for the empty set."""
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
            self.ends.append(min(((e, self.term[n]) for n, e in state if self.term[n] is not None and e <= self.allowed(self.term[n])), default=None))
            self.stems.append(next((self.stem[n] for n, e in sorted(state) if e == 0 and self.stem[n] is not None), None))
        return self.numbers[state]

    def _step(self, number: int, ch: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and edits < least.get(node, 99):
                least[node] = edits

        for node, edits in self.sets[number]:
            reach(node, edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, edits + (letter != ch))
        return self._number(self._closed(least))

    def find(self, word: str) -> tuple[int, str] | None:
        if len(self.sets) > MAX_STATES:
            self._restart()
        at, steps, stems, stem = self.begin, self.steps, self.stems, None
        for ch in word:
            nxt = steps[at].get(ch)
            if nxt is None:
                known = ch if ch in self.letters else ""
                nxt = steps[at].get(known)
                if nxt is None:
                    nxt = steps[at][known] = self._step(at, known)
            if nxt < 0:
                return stem
            at = nxt
            if stems[at] is not None:
                stem = (0, stems[at])
        end = self.ends[at]
        return stem if end is None or (end[0] and (stem is not None or word in self.clean)) else end


def _plain(word: str) -> str:
    return word if word.isalpha() else word.translate(LOOKALIKES)


def quotation(text: str, begin: int, end: int) -> float:
    """How likely the words at begin:end are quoted rather than meant, from the window around them on their line; 0 to 1."""
    line = text.rfind("\n", max(0, begin - WINDOW), begin) + 1
    before = text[max(line, begin - WINDOW) : begin]
    after = text[end : end + WINDOW].split("\n", 1)[0]
    marks = sum(before.count(q) for q in _QUOTES) % 2 and any(q in after for q in _QUOTES)
    near = [w.strip(".,;:!?\"'()") for w in (*before.split()[-NEAR:], *after.split()[:NEAR])]
    base, by_marks, by_word, by_address = QUOTATION
    odds = base + by_marks * bool(marks) + by_word * min(2, sum(w in REPORTING for w in near)) + by_address * any(w in ADDRESS for w in near)
    return float(1 / (1 + np.exp(-odds)))


def hits(text: str | None, lexicon: FuzzyLexicon) -> list[tuple[str, int, float, int, int]]:
    """(term, edits, likelihood of quotation, begin, end) of every hit in a whole text, in lower case."""
    low = (text or "").lower()
    found = {}
    for w in set(_TOKEN.findall(low)):
        if (hit := lexicon.find(_plain(w))) is not None:
            found[w] = hit
    if not found:
        return []
    return [(found[m[0]][1], found[m[0]][0], quotation(low, *m.span()), *m.span()) for m in _TOKEN.finditer(low) if m[0] in found]


def features(found: list[tuple], strength: dict[str, float], false: dict[str, int], context: bool = True) -> list[float]:
    """Damped sums of exact, misspelled and stem abuse and of quotation over a text's hits, and a constant; without context all is abuse.

    A hit counts by its term's strength, a misspelled one also by how rarely the term's misspellings came up in clean texts.
    """
    sums = [0.0] * 4
    for term, edits, q, _, _ in found:
        q, weight = q if context else 0.0, strength.get(term, 1.0) / (1 + false.get(term, 0) if edits else 1)
        sums[2 if term.endswith("*") else 1 if edits else 0] += (1 - q) * weight
        sums[3] += q * weight
    return [*map(float, np.log1p(sums)), 1.0]


#: What hits mean before any label is seen: weights of the features.
PRIOR = np.array([5.0, 4.0, 3.0, 1.0, -3.0])


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    clean: tuple[str, ...]
    strength: dict[str, float]  # of learned terms; others have 1
    false: dict[str, int]  # clean texts in which a word passed for a term's misspelling
    weights: tuple[float, ...]

    def score(self, texts, edits: bool = True, context: bool = True) -> np.ndarray:
        """0 to 1, higher: likelier toxic. Without ``edits`` only exact words are hits, without ``context`` all hits are abuse."""
        lexicon = _lexicon(self.terms, self.clean, edits)
        x = np.array([features(hits(t, lexicon), self.strength, self.false, context) for t in texts], dtype=float).reshape(-1, len(PRIOR))
        return 1 / (1 + np.exp(-(x @ np.array(self.weights))))


_lexicons: dict[tuple, FuzzyLexicon] = {}


def _lexicon(terms: tuple[str, ...], clean: tuple[str, ...] = (), edits: bool = True) -> FuzzyLexicon:
    if (terms, clean, edits) not in _lexicons:
        _lexicons.clear()
        _lexicons[terms, clean, edits] = FuzzyLexicon(terms, clean, edits)
    return _lexicons[terms, clean, edits]


def _chance(n: int, k: int, rate: float) -> float:
    """The probability of k or more toxic ones among n texts."""
    if k == n:
        return rate**n
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k, n + 1)]
    return math.fsum(map(math.exp, logs))


def _unlikely(counts: tuple[Counter, Counter], rate: float) -> dict[str, float]:
    """Words whose toxic counts aren't chance, with the chance: of those kept, a share of ``FALSE_TERMS`` is expected to be so.

    Words in so few texts that even all of them being toxic would be likely among so many words don't count as tried;
    so there is no fixed least number of texts.
    """
    sizes = Counter(k + counts[0][w] for w, k in counts[1].items())
    least, tried = 1, sum(sizes.values())
    while tried and rate**least * tried > FALSE_TERMS:
        tried -= sizes[least]
        least += 1
    chance = sorted((_chance(k + counts[0][w], k, rate), w) for w, k in counts[1].items() if k + counts[0][w] >= least)
    kept = max((i for i, (p, _) in enumerate(chance, 1) if p <= FALSE_TERMS * i / len(chance)), default=0)
    return {w: p for p, w in chance[:kept]}


def learn(texts: list[str | None], toxic: list[int]) -> tuple[dict[str, float], Counter]:
    """Terms and stems that are likelier in toxic texts than chance allows, with their strengths, and how many clean texts have each word.

    Copies and near copies count once, as their words aren't evidence of their own. Words of several toxic texts that begin with a learned stem
    and are no likelier in clean texts become terms beside it, so that their misspellings are found too. A strength is a term's
    log-odds, shrunk by half a text of either kind, over ``FULL``.
    """
    sketches: dict[int, int] = {}  # the least hashes of a text's words -> the text they came from
    words, stems, totals = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for i, (t, y) in enumerate(sorted(zip((t or "" for t in texts), toxic, strict=True))):
        own = {_plain(w) for w in _TOKEN.findall(t.lower())}
        sketch = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own)[:SKETCH]
        shared = Counter(sketches[h] for h in sketch if h in sketches)
        if shared and 2 * max(shared.values()) >= len(sketch):
            continue
        sketches.update((h, i) for h in sketch if h not in sketches)
        totals[y] += 1
        words[y].update(own)
        # A stem counts where a text has several words of it.
        begun = Counter(w[:k] + "*" for w in own for k in STEM if len(w) > k)
        stems[y].update(p for p, n in begun.items() if n > 1)
    if not all(totals):
        return {}, words[0]
    rate = totals[1] / sum(totals)

    def odds(counts: tuple[Counter, Counter], t: str) -> float:
        return math.log((counts[1][t] + 0.5) / (totals[1] + 1)) - math.log((counts[0][t] + 0.5) / (totals[0] + 1))

    found = {w: x for w in _unlikely(words, rate) if (x := odds(words, w)) >= math.log(LIFT)}
    chosen: list[str] = []
    for s, _ in sorted(((s, p) for s, p in _unlikely(stems, rate).items() if odds(stems, s) >= math.log(LIFT)), key=lambda x: (x[1], -len(x[0]), x[0])):
        # Of stems within one another the likeliest stays.
        if not any(s[:-1].startswith(c[:-1]) or c[:-1].startswith(s[:-1]) for c in chosen):
            chosen.append(s)
    begun_by = tuple(s[:-1] for s in chosen)
    found |= {w: odds(words, w) for w, k in words[1].items() if k > 1 and k * totals[0] > words[0][w] * totals[1] and w.startswith(begun_by)}
    found |= {s: odds(stems, s) for s in chosen}
    return {t: max(0.0, x) / FULL for t, x in found.items()}, words[0]


def _model(texts: list[str | None], toxic: list[int], seeds) -> ToxicityModel:
    """Terms, clean words and strengths, with the prior's weights."""
    strength, in_clean = learn(texts, toxic)
    terms = tuple(sorted({*seeds, *strength}))
    lexicon = FuzzyLexicon(terms)
    # Words of clean texts that would pass for misspellings.
    clean = tuple(sorted(w for w in in_clean if (hit := lexicon.find(w)) is not None and hit[0]))
    return ToxicityModel(terms, clean, strength, {}, tuple(map(float, PRIOR)))


def fit(texts: list[str | None], toxic: list[int], strength: float = 2.0, seeds=SEED_TERMS) -> ToxicityModel:
    """Terms and weights from labelled texts, drawn to the prior by ``strength`` pseudo-rows; no rows give the prior.

    Weights are fitted on hits of terms that were learned from other texts (``FOLDS`` parts, copies in one part), since a
    term's hits in the texts it comes from say more than they would elsewhere.
    """
    model, w, false = _model(texts, toxic, seeds), PRIOR.copy(), Counter()
    if texts:
        rows = sorted(zip((t or "" for t in texts), toxic, strict=True))
        part = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t, _ in rows])
        found, y = [([], {})] * len(rows), np.array([y for _, y in rows], dtype=float)
        for k in range(FOLDS):
            others = _model(*zip(*[r for r, p in zip(rows, part, strict=True) if p != k], strict=True), seeds) if (part != k).any() else _model([], [], seeds)
            lexicon = FuzzyLexicon(others.terms, others.clean)
            for i in np.flatnonzero(part == k):
                found[i] = hits(rows[i][0], lexicon), others.strength
                if not rows[i][1]:
                    false.update({term for term, edits, *_ in found[i][0] if edits})
        x = np.array([features(h, strengths, false) for h, strengths in found])
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-(x @ w)))
            gradient = x.T @ (y - p) - strength * (w - PRIOR)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        w[:4] = np.maximum(w[:4], 0.0)
    return replace(model, false=dict(false), weights=tuple(float(v) for v in w))


def fit_toxicity(labelled: DataFrame, sample: int = 6000, **options) -> ToxicityModel:
    """Fit on (doc_id, text, toxic): about ``sample`` rows with non-null toxic, by a hash of doc_id and text, or all where there are fewer."""
    known = labelled.where("toxic is not null").select("doc_id", "text", "toxic")
    n = known.select("doc_id").count()
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("toxicity sample")), F.lit(1_000_000))
    rows = known.where(point < (1_000_000 if n <= sample else int(1_000_000 * sample / n))).select("text", "toxic").collect()
    rows.sort(key=lambda r: (r["text"] or "", r["toxic"]))
    return fit([r["text"] for r in rows], [int(bool(r["toxic"])) for r in rows], **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on) added; columns of these names, in any case, are replaced.

    Whole texts are read; null and empty texts get the score of a text without hits; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t if isinstance(t, str) else None for t in texts]))

    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*own, score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
