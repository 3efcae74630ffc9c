"""Abusive, hateful and sexual content, told despite misreadings and disguise.

A noisy channel restores words: a token that can be read as a word that bears weight is laid out as a lattice of what
its characters may stand for (misread letters, digits and signs for letters, separators and repetitions put in), and the
cheapest path under a character model trained on all documents decides. A token that is too frequent for a misreading of
the word it would be restored to is a word of its own and stays. The restored text is scored by the largest weight of
distinct words within a window. Weights are log odds of words between the documents that readers marked and those they
didn't, taken at their lower confidence bound; a fixed list of abusive words is the prior where labels are few.

Null, empty and blank texts score 0. Texts are whole. Readers who disagree evenly, null verdicts and labels without a
document count for nothing; without labels the fixed list alone decides. Tokens of any length are read. Repeated rows are scored like others, other
columns pass unused, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut

THRESHOLD = 4.2
WINDOW = 44  # words: a sentence cut up by a neighbouring column still lies within
SUPPORT = 3  # marked documents that a word must be in to be learned
LABELLED_DOCUMENTS = 50_000  # documents that weights are fitted on, at most, by smallest hash of the id
PRIOR = 50.0  # strength of the fixed list, in documents
LEARNED_BOUND, TWOFOLD, LEAST_WEIGHT = 1.64, 0.7, 0.05  # one-sided 95 %, the log odds of a twofold frequency, and what is worth keeping
OWN_SHARE, OWN_COUNT = 0.1, 2  # a misreading is rarer than this share of its word's count, beyond this count

# fixed values: the prior, words that are abuse by themselves, and words that are in company
STRONG = """fuck fucks fucked fucker fuckers fucking motherfucker cunt cunts shithead shit arsehole arseholes asshole assholes whore whores slut sluts bollocks wanker wankers twat pisshead
nigger niggers faggot faggots kike subhuman subhumans untermensch untermenschen arschloch arschlöcher hurensohn hure huren fotze ficken fickt fickte gefickt wichser schlampe missgeburt drecksau
connard connards enculé enculer salope salopes salaud salauds pute putes putain baiser baisait baisa sous-hommes sous-homme batard nègre pédé""".split()
COMPANY = """bastard bastards bitch bitches cock cocks tits swine scum vermin cur hag trollop cretin idiot moron bugger damn damned goddamned filthy stinking gutless snivelling worthless brainless rotten drunken
wretch scoundrel mongrel lice parasites exterminated muzzle sows cripples naked nude writhed moaned gasped groan licked sucked thighs schwein abschaum dreckiges verdammter verfluchter elendes ungeziefer ausgerottet
totgeschlagen nackt stöhnte leckte espèce vermine extermine nue gémissait léchait""".split()

# fixed values: what a character may stand for, besides itself
READINGS = {
    "0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "6": "éeb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
    "c": "eoé", "e": "coé", "o": "ac", "a": "o", "l": "it", "i": "lt", "f": "st", "t": "fl", "s": "f", "u": "n", "n": "u", "h": "b", "b": "h", "q": "g", "g": "q", "y": "v", "v": "y", "ä": "a", "é": "e", "è": "e", "ê": "e", "ü": "u", "ö": "o", "à": "a",
}
MERGED = {"vv": "w", "rn": "m", "cl": "d", "ii": "u", "li": "h", "ri": "n"}
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzßàâäáæçèéêëìíîïñòóôöœùúûüÿ")
SPELLING = 64  # characters of the longest token that may be a word of its own
SEPARATORS = ".-_*·^~'’`´,:;•|/\\=¬­"

_BREAKS = re.compile(r"[-¬=‐‑­]\s*\n\s*")
_MASKED = re.compile(r"^([a-zà-ÿ]{1,3})(?:[—–*_#.]{2,}|-{2,}|[*#])([a-zà-ÿ]{0,3})$")
_REPEATED = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_STRIP = ".,;:!?\"'»«„“”‘’()[]…*☞°"


class Readable:
    """Whether a word's lattice has a path that spells one of some words: the moves of `restore`, along a trie, without costs."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = {}

    def __contains__(self, token: str) -> bool:
        size, (limit, counts) = len(token), _limit(token)
        first = {token[0], *READINGS.get(token[0], ""), MERGED.get(token[:2], "")}
        if token[0] not in SEPARATORS and first.isdisjoint(self.root):
            return False
        seen, todo = set(), [(0, "", 0, self.root)]
        while todo:
            k, last, edits, node = todo.pop()
            if k == size:
                if "" in node:
                    return True
                continue
            if (k, id(node), last, edits) in seen:
                continue
            seen.add((k, id(node), last, edits))
            c = token[k]
            if c in node and (c.isalpha() or c == "-"):
                todo.append((k + 1, c, edits, node[c]))
            if c in SEPARATORS:
                todo.append((k + 1, last, edits, node))
            if edits + counts(c) <= limit:
                todo += [(k + 1, r, edits + counts(c), node[r]) for r in READINGS.get(c, "") if r in node]
            if edits < limit:
                pair = MERGED.get(token[k : k + 2])
                if pair in node:
                    todo.append((k + 2, pair, edits + 1, node[pair]))
            more = c != token[k - 1] and counts(c)
            if last and (c == last or last in READINGS.get(c, "")) and edits + more <= limit:
                todo.append((k + 1, last, edits + more, node))
        return False


def triples_of(word: str) -> list[str]:
    """Each character of a word, and its end, behind the two before."""
    text = "^^" + word + "$"
    return [text[k - 2 : k + 1] for k in range(2, len(text))]


class CharacterModel:
    """Costs (-log probabilities) of characters after the two before, from words and their weights."""

    def __init__(self, words: dict[str, float], triples: dict[str, float] | None = None):
        self.counts: dict[str, dict[str, float]] = {}
        self.totals: dict[str, float] = {}
        given = Counter(triples or {})
        for word, weight in words.items():
            for triple in triples_of(word):
                given[triple] += weight
        for triple, weight in given.items():
            for context in (triple[:2], triple[1]):
                self.counts.setdefault(context, {}).setdefault(triple[2], 0.0)
                self.counts[context][triple[2]] += weight
                self.totals[context] = self.totals.get(context, 0.0) + weight

    def cost(self, context: str, char: str) -> float:
        p = 1e-3
        for c, share in ((context[-1], 0.3), (context, 0.7)):
            if c in self.totals:
                p += share * self.counts[c].get(char, 0.0) / self.totals[c]
        return -math.log(p)


def _limit(token: str) -> tuple[int, Callable[[str], bool]]:
    """How many misreadings count at most, and which characters' count: one in four, once at least.

    Digits and signs, which must be read as letters, use up the limit but aren't held to it, if there is a letter beside
    them: a number alone is no disguise.
    """
    limit = max(1, len(token) // 4)
    if not any(map(str.isalpha, token)):
        return limit, lambda c: True
    signs = sum(not c.isalpha() and c not in SEPARATORS and c != before for before, c in zip(" " + token, token))
    return max(0, limit - signs), str.isalpha


def restore(token: str, model: CharacterModel) -> str:
    """The cheapest reading of a token: Viterbi over its lattice; states are the last two characters.

    Misreadings are limited (see `_limit`); separators and repetitions go freely.
    """
    limit, counts = _limit(token)
    best: list[dict[tuple[str, int], tuple[float, str]]] = [{} for _ in range(len(token) + 1)]
    best[0]["^^", 0] = (0.0, "")

    def step(at: int, context: str, edits: int, cost: float, text: str) -> None:
        if edits <= limit and ((context, edits) not in best[at] or cost < best[at][context, edits][0]):
            best[at][context, edits] = (cost, text)

    for k, c in enumerate(token):
        for (context, edits), (cost, text) in list(best[k].items()):
            for emitted, paid, more in ((c, 0.05, 0), *((r, 2.2, counts(c)) for r in READINGS.get(c, ""))):
                if emitted.isalpha() or emitted == "-":
                    step(k + 1, context[1] + emitted, edits + more, cost + paid + model.cost(context, emitted), text + emitted)
            pair = MERGED.get(token[k : k + 2])
            if pair:
                step(k + 2, context[1] + pair, edits + 1, cost + 2.2 + model.cost(context, pair), text + pair)
            if c in SEPARATORS:
                step(k + 1, context, edits, cost + 1.0, text)
            if text and (c == text[-1] or text[-1] in READINGS.get(c, "")):
                step(k + 1, context, edits + (c != token[k - 1] and counts(c)), cost + 1.6, text)
    ends = [(cost + model.cost(context, "$"), text) for (context, _), (cost, text) in best[-1].items()]
    return min(ends)[1] if ends else token


class Weigher(dict):
    """Memo from tokens to (word, weight), or None for tokens that bear none."""

    def __init__(self, weights: dict[str, float], own: set[str], model: CharacterModel):
        self.weights, self.own, self.model = weights, own, model
        self.readable = Readable(weights)
        self.once: dict[str, list[str]] = {}  # words by themselves without repetitions
        for w in weights:
            self.once.setdefault(_REPEATED.sub(r"\1", w), []).append(w)
        self.ends = [(w, weights[w]) for w in STRONG + COMPANY if weights.get(w, 0) > 0]

    def look(self, token: str) -> tuple[str, float] | None:
        word = token.strip(_STRIP)
        if not word:
            return None
        if word in self.weights:
            return word, self.weights[word]
        m = _MASKED.match(word)
        if m and len(word) > 2:
            head, tail = m.groups()
            fits = [(v, w) for w, v in self.ends if w.startswith(head) and w.endswith(tail) and len(w) >= len(head) + len(tail) + 1]
            return (f"{head}*{tail}", 2.0) if fits else None
        word = _LONG_RUN.sub(r"\1\1\1", word)
        if word in self.own or len(word) < 3 or word not in self.readable:
            return None
        found = restore(word, self.model)
        if found not in self.weights:  # a doubled letter may be the word's own
            found = next((w for w in self.once.get(_REPEATED.sub(r"\1", found), ()) if word in Readable((w,))), found)
        return (found, 0.9 * self.weights[found]) if self.weights.get(found, 0) > 0 else None

    def __missing__(self, token: str) -> tuple[str, float] | None:
        value = self.look(token)
        if len(token) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[token] = value
        return value


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens between blanks, words broken at line ends joined, letters spaced out joined."""
    if "\n" in text:
        text = _BREAKS.sub("", text)
    return text.lower().split()


def _joined(tokens: list[str]) -> Iterator[tuple[int, str]]:
    """Runs of three or more single letters, as one token each."""
    at = 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and len(tokens[end].strip(SEPARATORS)) == 1 and tokens[end].strip(SEPARATORS).isalnum():
            end += 1
        if end - at >= 3:
            yield at, "".join(t.strip(SEPARATORS) for t in tokens[at:end])
        at = max(end, at + 1)


def score(text: str | None, weigh: Weigher, window: int = WINDOW) -> float:
    """The largest sum of the weights of distinct words within a window of a text."""
    if not text:
        return 0.0
    tokens = tokens_of(text)
    events = [(k, w) for k, w in enumerate(map(weigh.__getitem__, tokens)) if w]
    if " " in text and re.search(r"(?:(?<=\s)|^)\w[.\-_*]?\s\w[.\-_*]?\s\w(?=\W)", text):
        events = sorted(events + [(k, w) for k, t in _joined(tokens) if (w := weigh[t])])
    if not events:
        return 0.0
    best, first, inside, total = 0.0, 0, {}, 0.0
    for k, (word, value) in events:
        while events[first][0] < k - window:
            old = events[first][1]
            inside[old[0]][0] -= 1
            if not inside[old[0]][0]:
                total -= inside.pop(old[0])[1]
            first += 1
        if word in inside:
            inside[word][0] += 1
        else:
            inside[word] = [1, value]
            total += value
        best = max(best, total)
    return best


def _prior(word: str) -> tuple[float, float]:
    if word in _STRONG:
        return 0.2, 0.0005
    if word in _COMPANY:
        return 0.06, 0.002
    return 0.002, 0.01  # half a document: an unseen word is as likely as one that is seen once in two corpora


_STRONG, _COMPANY = frozenset(STRONG), frozenset(COMPANY)


def weight(word: str, marked: int, plain: int, n_marked: int, n_plain: int) -> float:
    """Lower bound of a word's log odds, less what a twofold frequency gives; fixed words have their prior odds where labels are few."""
    p0, q0 = _prior(word)
    p, q = marked + PRIOR * p0, plain + PRIOR * q0
    odds = math.log(p / (n_marked + PRIOR)) - math.log(q / (n_plain + PRIOR))
    if word in _STRONG:
        return min(6.0, max(odds + 1.0, 0.0))
    if word in _COMPANY:
        return min(2.0, max(odds - 0.5 * math.sqrt(1 / p + 1 / q) - TWOFOLD, 0.0))
    return min(1.5, max(odds - LEARNED_BOUND * math.sqrt(1 / p + 1 / q) - TWOFOLD, 0.0))


def learn(documents: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Weights of words by the labelled documents, of which LABELLED_DOCUMENTS at most are read.

    Beside the fixed list every word counts that SUPPORT marked documents have and whose odds are above chance at the
    lower bound; only those come to the driver.
    """
    votes = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("mean")).where("mean <> 0.5")
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_DOCUMENTS).select("doc_id", (F.col("mean") > 0.5).cast("int").alias("marked"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks, lower = [], [], []
            for text, marked in zip(batch.column("text").to_pylist(), batch.column("marked").to_pylist()):
                split = [t.strip(_STRIP) for t in _BREAKS.sub("", text).split()]
                small = {w for w in split if w and w[0].islower()}
                own = {w.lower() for w in split if w and w[0].isalpha()} | {""}
                lower.extend(int(w in small) for w in own)
                words.extend(own)
                marks.extend([marked] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int32()), pa.array(lower, pa.int32())], names=["word", "marked", "small"])

    counts = cut(texts.select("text", "marked").mapInArrow(run, "word string, marked int, small int").groupBy("word").agg(F.avg("small").alias("small"), F.sum("marked").cast("long").alias("p"), F.sum(1 - F.col("marked")).cast("long").alias("n")))
    fixed = F.col("word").isin(*STRONG, *COMPANY, "")
    totals = F.broadcast(counts.where("word = ''").select(F.col("p").alias("all_p"), F.col("n").alias("all_n")))  # one row
    p0, q0 = _prior("")
    p, q = F.col("p") + PRIOR * p0, F.col("n") + PRIOR * q0
    low = F.log(p / (F.col("all_p") + PRIOR)) - F.log(q / (F.col("all_n") + PRIOR)) - LEARNED_BOUND * F.sqrt(1 / p + 1 / q) - TWOFOLD
    learned = counts.join(totals).where(fixed | ((F.col("p") >= SUPPORT) & (F.col("small") >= 0.3) & (low > LEAST_WEIGHT)))  # names bear no weight
    seen = {r.word: (r.p, r.n) for r in learned.select("word", "p", "n").collect()}
    n_marked, n_plain = seen.pop("", (0, 0))
    weights = {w: weight(w, *seen.get(w, (0, 0)), n_marked, n_plain) for w in {*seen, *STRONG, *COMPANY}}
    return {w: round(v, 4) for w, v in sorted(weights.items()) if v > LEAST_WEIGHT}


def corpus_statistics(documents: DataFrame, weights: dict[str, float]) -> tuple[dict[str, int], dict[str, int]]:
    """Counts over all documents: of tokens that are, or can be read as, words that bear weight, and of triples of letters.

    Counts are combined in each task. Triples are of LETTERS only, so their number is bounded; tokens are spellings within
    the lattice's limits of a few hundred words, and of others than those words only counts beyond OWN_COUNT are told.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readable, counts = Readable(weights), Counter()

        def told() -> pa.RecordBatch:
            tokens, triples = {}, Counter()
            for word, n in counts.items():
                if word in weights or len(word) >= 3 and len(word) <= SPELLING and word in readable:
                    tokens[word] = n
                if LETTERS.issuperset(word):
                    for triple in triples_of(word):
                        triples[triple] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([False] * len(tokens) + [True] * len(triples)), pa.array([*tokens, *triples], pa.string()), pa.array([*tokens.values(), *triples.values()], pa.int64())], names=["triple", "text", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(t.strip(_STRIP) for t in tokens_of(text))
            if len(counts) >= 400_000:
                yield told()
        yield told()

    rows = documents.where(F.col("text").isNotNull()).select("text").mapInArrow(run, "triple boolean, text string, n long").groupBy("triple", "text").agg(F.sum("n").alias("n"))
    rows = rows.where(F.col("triple") | (F.col("n") > OWN_COUNT) | F.col("text").isin(*weights)).collect()
    return {r.text: r.n for r in rows if not r.triple}, {r.text: r.n for r in rows if r.triple}


def own_words(counts: dict[str, int], weights: dict[str, float], model: CharacterModel) -> set[str]:
    """Tokens too frequent for misreadings of the word that they would be restored to."""
    weigher = Weigher(weights, set(), model)
    out = set()
    for token, n in counts.items():
        found = None if token in weights else weigher.look(token)
        if found and n > OWN_COUNT + OWN_SHARE * counts.get(found[0], 0):
            out.add(token)
    return out


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, source, score, toxic) of every row."""
    weights = learn(documents, labels)
    counts, triples = corpus_statistics(documents, weights)
    emphasis = 1 + sum(triples.values()) / 1e5  # words that bear weight are in the model even where the corpus has none
    model_words = {w: emphasis for w in weights}
    own = own_words(counts, weights, CharacterModel(model_words, triples))
    state: list[Weigher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Weigher(weights, own, CharacterModel(model_words, triples)))
        for batch in batches:
            texts = batch.column("text")
            scores = [score(texts[k].as_py(), state[0]) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double").withColumn("toxic", F.col("score") >= threshold)


def rates(scored: DataFrame) -> DataFrame:
    """Documents, those found and their rate per source ('' where null)."""
    return scored.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("toxic").cast("long")).alias("found")).withColumn("rate", F.col("found") / F.col("documents"))
