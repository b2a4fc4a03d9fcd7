"""Abusive, hateful and sexually explicit text.

1. A lexicon (common abusive terms and terms that reviewers' labels single out) is held as a trie; a Levenshtein automaton runs over
   it and finds misspelt, stretched, masked, spaced-out and look-alike forms of its terms.
2. Each term found is judged in its context window: words and word pairs around it, weighed by a logistic model that was
   fitted on a bounded sample of labelled documents (several windows a document, one of which must bear the label out),
   so reports, rules, medicine, animals and tools that use the same words score low.
3. A document's score is that of its worst window.

Training texts are read, cut into windows and counted by the executors (``train``); one task fits the counted windows, and only words
and weights reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import doubles
from reelspark.llm.text import fold, plain
from reelspark.session import cut_lineage

MAX_LABELLED = 40_000  # labelled documents that are fitted on, whole
MAX_WINDOWS = 400_000  # and their windows that hold a term: what the fitting task holds stays below about 500 MB
BITS = 18
WINDOW = 24  # words of a context window
STEP = 12

# fixed values: terms of the start lexicon, by kind; folded forms.  Common abuse only: what is particular to a corpus is learned
INSULTS = """
idiot moron imbecile cretin halfwit retard dumbass bastard bitch scumbag maggot parasite leech loser clown vermin slut whore
asshole worthless pathetic brainless disgusting filthy stupid stinking miserable dumb scum pig subhuman
abschaum drecksack versager schlampe hurensohn arschloch fotze missgeburt widerlich ungeziefer
connard salope minable debile encule putain ordure vermine
basura inutil imbecil idiota puta cabron gilipollas asqueroso mierda
stronzo puttana bastardo
""".split()
THREATS = """
kill die drown burn hang choke bleed slap beat shoot stab strangle
verrecken umbringen verprugeln schlagen crever tuer frapper matar mueras golpear morire
""".split()
SEXUAL = """
fuck fucking naked nudes porn tits ass cock dick pussy horny undress sex grope
titten ficken desnuda follar seins nue
""".split()
HATE = """
foreigners refugees immigrants women disabled unbelievers inferior
auslander fluchtlinge etrangers inmigrantes
""".split()
# fixed values: words that speak to or about a person, and words that report, rule or explain
AIMED = "you your yours yourself u ur du dein deine dich dir tu te tes ta toi eres tus whoever those they them all alle".split()
DISTANT = "i me my ich je yo rules policy explain explains report reported history film word words wrote said says quote doctor health".split()
SIGNS = {"@": "a", "$": "s", "!": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "€": "e", "+": "t", "|": "i"}  # fixed values

_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:([ .\-_·*])[^\W\d_])(?:\1[^\W\d_])+(?!\w)")
_TOKEN = re.compile(r"[^\W_](?:[\w*#@$!€+|'’\-]*[\w*#@$€])?|[@$€][\w*#@$!]+")
_ENDS = re.compile(r"\n+|(?<=[.!?…。！？؟])[\"'”»)\]]*\s+|[。！？]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_RUN = re.compile(r"(.)\1{2,}")
_PAIR = re.compile(r"(.)\1+")


class Trie:
    """Terms as a tree; ``search`` walks it with the states of the word's Levenshtein automaton."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def search(self, word: str, most: int) -> str | None:
        """The nearest term within ``most`` edits; '*' in the word stands for any letter.  Ties go by the term."""
        best: tuple[int, str] | None = None
        n, far = len(word), most + 1
        # state of the automaton: edits so far for the word's prefixes; prefixes off the diagonal by more than ``most`` are out of reach
        stack = [(self.root, 0, [i if i <= most else far for i in range(n + 1)])]
        while stack:
            node, depth, row = stack.pop()
            if "" in node and row[n] <= most and (best is None or (row[n], node[""]) < best):
                best = (row[n], node[""])
            depth += 1
            lo, hi = max(1, depth - most), min(n, depth + most)
            for c, child in node.items():
                if c == "":
                    continue
                new = [far] * (n + 1)
                if depth <= most:
                    new[0] = depth
                least = new[0]
                left, corner = new[lo - 1], row[lo - 1]
                for i in range(lo, hi + 1):
                    w = word[i - 1]
                    up = row[i]
                    v = corner if w == c or w == "*" else corner + 1
                    if up < v:
                        v = up + 1 if up + 1 < v else v
                    if left + 1 < v:
                        v = left + 1
                    new[i] = left = v
                    corner = up
                    if v < least:
                        least = v
                if least <= most:
                    stack.append((child, depth, new))
        return best[1] if best else None

    def resolve(self, token: str, known) -> str | None:
        """The lexicon term that a token is a form of, or None."""
        masked = "*" in token or "#" in token
        signed = any(c in SIGNS for c in token) and any(c.isalpha() for c in token)
        base = token.replace("#", "*") if masked else token
        if signed and not masked:
            base = "".join(SIGNS.get(c, c) for c in token)
        if masked:
            letters = sum(c != "*" for c in base)
            return self.search(base, 0) if len(base) >= 4 and letters >= 2 else None
        node = self.root
        for c in base:
            node = node.get(c)
            if node is None:
                break
        if node is not None and "" in node:
            return base
        if base in known or not base.isalpha():
            return None
        runs = _RUN.sub(r"\1", base)
        if runs != base:
            for form in (_RUN.sub(r"\1\1", base), runs, _PAIR.sub(r"\1", base)):
                if (hit := self.search(form, 0)) is not None:
                    return hit
            flat = _PAIR.sub(r"\1", base)
            for t in (self.search(runs, 1), self.search(flat, 1)):
                if t is not None and len(t) >= 4:
                    return t
            return None
        n = len(base)
        most = 0 if n < 4 else 1 if n < 8 else 2
        hit = self.search(base, most) if most else None
        if hit is None and n >= 4:  # two letters swapped are two edits for the automaton
            swaps = (base[:i] + base[i + 1] + base[i] + base[i + 2 :] for i in range(n - 1))
            hit = next((t for t in map(lambda f: self.search(f, 0), swaps) if t is not None), None)
        # any letter may be wrong; of words of four letters the first must be right, as too many common words differ in it
        return hit if hit is not None and len(hit) >= 4 and (n > 4 or hit[0] == base[0]) else None


_SHAPES: dict[str, tuple[str, ...]] = {}


def shape(token: str) -> tuple[str, ...]:
    """Folded words of a token (none, one, or the letter pairs of scripts without spaces); tokens recur, so answers are kept."""
    got = _SHAPES.get(token)
    if got is None:
        w = fold(token).strip("-'’!")
        if _WIDE.search(w):
            got = tuple(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        elif w:
            w = w.replace("'", "").replace("’", "")
            plainer = w.replace("-", "")
            parts = w.split("-")
            got = (plainer if len(parts) > 2 and all(len(p) == 1 for p in parts) else "0" if plainer.isdigit() else plainer,)
        else:
            got = ()
        if len(_SHAPES) < 300_000 and len(token) < 64:
            _SHAPES[token] = got
    return got


def sentences(text: str) -> list[list[str]]:
    """Sentences as tokens (folded; masks and signs kept inside words; scripts without spaces as letter pairs)."""
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_·*]", "", m.group()), plain(text))
    out = []
    for s in _ENDS.split(t):
        row = [w for m in _TOKEN.findall(s) for w in shape(m)]
        if row:
            out.append(row)
    return out


class Model:
    """Lexicon, known words and the weights of context features."""

    def __init__(self, terms, known, weights, bias: float):
        self.terms, self.known, self.weights, self.bias = frozenset(terms), known, weights, bias
        self.trie = Trie(sorted(self.terms))
        self.seen: dict[str, str | None] = {}

    def __getstate__(self):
        return self.terms, self.known, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def canonical(self, row: list[str]) -> tuple[list[str], list[int]]:
        """Tokens with lexicon forms resolved, and the positions of lexicon terms."""
        out, hits = [], []
        seen = self.seen
        for i, w in enumerate(row):
            t = seen.get(w, "")
            if t == "":
                t = w if w in self.terms else None if w.isalpha() and w in self.known else self.trie.resolve(w, self.known)
                if len(seen) < 300_000 and len(w) < 64:
                    seen[w] = t
            if t:
                out.append(t)
                hits.append(i)
            else:
                out.append(w)
        return out, hits

    def windows(self, text: str):
        """(canonical tokens, hits) of each window that holds a lexicon term."""
        for row in sentences(text):
            toks, hits = self.canonical(row)
            if not hits:
                continue
            if len(toks) <= WINDOW:
                yield toks, hits
                continue
            for s in range(0, max(1, len(toks) - WINDOW + STEP), STEP):
                inside = [h - s for h in hits if s <= h < s + WINDOW]
                if inside:
                    yield toks[s : s + WINDOW], inside

    def score(self, text: str) -> tuple[float, str]:
        """(score, terms) of the worst window; (0.0, '') without any term."""
        best, why = 0.0, ""
        for toks, hits in self.windows(text):
            z = self.bias + sum(self.weights[f] for f in features(toks))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            if p > best:
                best, why = p, " ".join(sorted({toks[h] for h in hits}))
        return best, why


def features(toks: list[str]) -> set[int]:
    mask = (1 << BITS) - 1
    out = {zlib.crc32(w.encode()) & mask for w in toks}
    out |= {zlib.crc32(f"{a} {b}".encode()) & mask for a, b in zip(["^", *toks], [*toks, "$"])}
    out |= {zlib.crc32(f"{a}  {b}".encode()) & mask for a, b in zip(toks, toks[2:])}
    return out


def prior_weights():
    """Weights before any label is seen: terms count, more so when aimed at somebody, less so in reports."""
    import numpy as np

    w = np.zeros(1 << BITS)
    mask = (1 << BITS) - 1
    for terms, value in ((INSULTS, 1.6), (THREATS, 1.0), (SEXUAL, 1.4), (HATE, 0.6), (AIMED, 1.2), (DISTANT, -1.6)):
        for t in terms:
            w[zlib.crc32(t.encode()) & mask] = value
    return w


PRIOR_BIAS = -3.0


MIN_RATE = 5.0  # a word is learned as a term if it stands so many times as often in bad documents as in others
MIN_DOCS = 4  # and in so many bad documents
KNOWN_DOCS = 5  # words of so many labelled documents are no misspellings


def learned(counts, n1: int, n0: int) -> set[str]:
    """Terms that the labels single out, of (word, bad documents, other documents)."""
    if n1 < 20 or n0 < 20:
        return set()
    return {w for w, k, other in counts if k >= MIN_DOCS and w != "0" and len(w) > 1 and not any(c in w for c in "*#") and k / n1 >= MIN_RATE * (other + 1) / n0}


def windows_of(model: Model, rows: list[list[str]]):
    """Canonical windows of a document that hold a term."""
    for r in rows:
        toks, hits = model.canonical(r)
        if hits:
            for s in range(0, max(1, len(toks) - WINDOW + STEP), STEP) if len(toks) > WINDOW else (0,):
                yield tuple(toks[s : s + WINDOW])


def fit_windows(windows: list[tuple[str, ...]], counts, rounds: int = 3, steps: int = 100, ridge: float = 0.3, low: float = 0.05, high: float = 0.7):
    """(features, their weights, bias) from distinct windows and [other, bad] numbers of documents that hold them.

    Features of a single window keep their prior: they tell nothing about others.
    """
    import numpy as np

    feats = [np.fromiter(features(list(t)), np.int64) for t in windows]
    ids = np.concatenate(feats)
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    used, at, often = np.unique(ids, return_inverse=True, return_counts=True)
    base = prior_weights()
    fixed = np.bincount(row, np.where(often[at] < 2, base[ids], 0.0), len(feats))
    many = often[at] >= 2
    used, at = np.unique(ids[many], return_inverse=True)
    row = row[many]
    c = np.asarray(counts, float)
    prior = base[used]
    w, b = prior.copy(), PRIOR_BIAS
    weight0, weight1 = c[:, 0].copy(), c[:, 1].copy()
    chance = lambda: 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(feats)) + fixed + b, -30, 30)))
    for _ in range(rounds):
        m1, v1, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, steps + 1):
            g = chance() * (weight0 + weight1) - weight1
            gw = np.bincount(at, g[row], len(w)) + ridge * (w - prior)
            gb = g.sum()
            m1, v1 = 0.9 * m1 + 0.1 * gw, 0.99 * v1 + 0.01 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            k = 1 - 0.9**step, 1 - 0.99**step
            w = w - 0.15 * (m1 / k[0]) / (np.sqrt(v1 / k[1]) + 1e-8)
            b = b - 0.15 * (mb / k[0]) / (math.sqrt(vb / k[1]) + 1e-8)
        # a labelled document needs only one bad window, and some labels are wrong: windows that the model
        # finds harmless do not count as bad, and windows that it finds bad do not count as harmless
        p = chance()
        weight1 = np.where(p >= low, c[:, 1], 0.0)
        weight0 = np.where(p >= high, 0.0, c[:, 0] + np.where(p < low, c[:, 1], 0.0))
    return used, w, float(b)


def with_weights(model: Model, used, w, bias: float) -> Model:
    full = prior_weights()
    full[used] = w
    return Model(model.terms, model.known, full, bias)


SEEDS = frozenset({*INSULTS, *THREATS, *SEXUAL, *HATE})


def fit(rows: list[tuple[str, float]]) -> Model:
    """Model from (text, label) of a few labelled documents, here; ``train`` does the same on the executors.  With few or no labels the prior stands."""
    docs = [(sentences(t), y) for t, y in rows if t]
    n1 = sum(1 for _, y in docs if y > 0.5)
    n0 = len(docs) - n1
    number: dict[str, list[int]] = {}
    for rows_, y in docs:
        for w in {w for r in rows_ for w in r}:
            number.setdefault(w, [0, 0])[y > 0.5] += 1
    known = frozenset(w for w, k in number.items() if sum(k) >= KNOWN_DOCS)
    model = Model(SEEDS | learned(((w, k[1], k[0]) for w, k in number.items()), n1, n0), known, prior_weights(), PRIOR_BIAS)
    count: dict[tuple[str, ...], list[int]] = {}
    for rows_, y in docs:
        for t in windows_of(model, rows_):
            count.setdefault(t, [0, 0])[y > 0.5] += 1
    if n1 < 20 or n0 < 20 or not count:
        return model
    windows = sorted(count)
    return with_weights(model, *fit_windows(windows, [count[t] for t in windows]))


def labelled_sample(documents: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, text, y): about ``MAX_LABELLED`` labelled documents at most, drawn by hash, with whole texts and their mean label.

    Labels are averaged over the reviewers of a document; documents on which they are split even are left out.
    """
    marks = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y")).where("y <> 0.5")
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31))
    marks = cut_lineage(marks)
    n = marks.count()
    if n > MAX_LABELLED:
        marks = marks.where(lot < int((1 << 31) * MAX_LABELLED / n))
    texts = documents.where("text IS NOT NULL").select("doc_id", "text")
    # about MAX_LABELLED rows of two numbers at most, so this side may be broadcast
    return texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Model from a bounded sample of labelled documents.  The driver gets the known words and the weights (at most 2^18)."""
    spark = documents.sparkSession

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [sentences(t) for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, kind)], ["doc_id", "y", "rows"])

    sample = labelled_sample(documents, labels)
    key = sample.schema["doc_id"].dataType.simpleString()
    docs = cut_lineage(sample.select("doc_id", "text", "y").mapInArrow(cut, f"doc_id {key}, y double, rows array<array<string>>"))
    bad = (F.col("y") > 0.5).cast("int")
    n, n1 = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(bad), F.lit(0))).first()
    words = docs.select(bad.alias("bad"), F.explode(F.array_distinct(F.flatten("rows"))).alias("w"))
    words = words.groupBy("w").agg(F.sum("bad").alias("k"), F.count(F.lit(1)).alias("n"))
    words = words.where((F.col("n") >= KNOWN_DOCS) | (F.col("k") >= MIN_DOCS)).collect()
    terms = learned(((r.w, r.k, r.n - r.k) for r in words), n1, n - n1)
    model = Model(SEEDS | terms, frozenset(r.w for r in words if r.n >= KNOWN_DOCS), prior_weights(), PRIOR_BIAS)
    if n1 < 20 or n - n1 < 20:
        return model
    shared = spark.sparkContext.broadcast(model)

    def windows(batches):
        import pyarrow as pa

        for batch in batches:
            ids, text, y = [], [], []
            for i, (mark, rows) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for t in windows_of(shared.value, rows):
                    ids.append(i)
                    text.append(" ".join(t))
                    y.append(mark)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(text, pa.string()), pa.array(y, pa.float64())], ["doc_id", "win", "y"])

    held = cut_lineage(docs.mapInArrow(windows, f"doc_id {key}, win string, y double"))
    total = held.count()
    if total > MAX_WINDOWS:  # fewer documents, by hash, with all of their windows
        held = held.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 31)) < int((1 << 31) * MAX_WINDOWS / total))
    # equal windows are fitted once, with the number of documents of either label that hold them
    counted = held.groupBy("win").agg(F.sum((F.col("y") <= 0.5).cast("double")).alias("n0"), F.sum((F.col("y") > 0.5).cast("double")).alias("n1"))

    def fitted(batches):
        import numpy as np
        import pyarrow as pa

        text, counts = [], []
        for batch in batches:
            text += [tuple(t.split(" ")) for t in batch.column(0).to_pylist()]
            counts.append(np.stack([doubles(batch.column(1)), doubles(batch.column(2))], 1))
        if text:
            used, w, b = fit_windows(text, np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[w, b])], ["feature", "weight"])

    got = counted.repartition(1).sortWithinPartitions("win").mapInArrow(fitted, "feature bigint, weight double").toArrow()
    if not got.num_rows:
        return model
    feature, weight = got.column("feature").to_numpy(), got.column("weight").to_numpy()
    return with_weights(model, feature[:-1], weight[:-1], float(weight[-1]))


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score, terms): score in [0, 1] of each document's worst window and the lexicon terms in it.

    NULL, empty and blank texts score 0.  Rows come out as often as they stand.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    cols = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1]) + ", score double, terms string"

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            got = [model.score(t) if t else (0.0, "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [*batch.columns[:-1], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "score", "terms"])

    return cols.mapInArrow(run, schema)
