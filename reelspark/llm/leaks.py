"""Evaluation passages inside training text, by a stored positional inverted index of the training tokens.

1. ``index_corpus`` reads each training text once and stores its postings: per shard of documents the terms, and for each term the documents
   and positions that hold it.  Shards are written where they are made; nothing is shuffled, and the index serves any set of items.
2. Items lose their stock instruction and closing question; what is left is the passage.
3. In each shard the passages' words, with their misspellings, pick their lists.  Documents whose lists together lack too much
   of the weight of every stretch of a passage fall out, the rarest words weighing most; the test drops nothing that the alignment accepts.
4. For the rest the offset-adjusted lists are intersected in order of position: matches in order, single words between them replaced, misspelt,
   dropped or added.  Stretches that stand there word for word are exact phrases, the others proximity matches.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import ints
from reelspark.llm.text import plain, words
from reelspark.session import cut_lineage

MAX_WORDS = 20_000  # passages are looked up in parts of about so many words (up to 100 MB with their misspellings)
SHARD_TOKENS = 400_000  # a shard ends with the document that passes so many tokens
STOCK_ITEMS = 5  # an opening sentence before at least so many different rests is a stock instruction

_SENTENCE = re.compile(r"[^.?!:\n]*[.?!:\n]+\s*")


@lru_cache(maxsize=1 << 18)
def close(a: str, b: str) -> bool:
    """Equal, or one edit apart (two for words of eight letters or more), numbers never."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if min(la, lb) < 4 or a.isdigit() or b.isdigit():
        return False
    most = 2 if min(la, lb) >= 8 else 1
    if abs(la - lb) > most or (a[0] != b[0] and a[-1] != b[-1]):
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(la, lb) - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    x, y = a[i : la - j], b[i : lb - j]
    if max(len(x), len(y)) <= 1 or (most == 2 and max(len(x), len(y)) <= 2):
        return True
    return len(x) == 2 and x == y[::-1]  # two letters swapped


def best_stretch(item: list[str], weight: list[float], doc: list[str], min_words: int = 1, density: float = 0.0) -> tuple[int, float]:
    """(span, share) of the longest stretch of the item's words that stands in the document in order; (0, 0.0) if there is none.

    Between two matched words at most one word is missing or foreign on either side.  Span counts the item's words from
    the first to the last match, share is the matched part of their weight.  Only stretches of at least ``min_words`` words and
    a share of at least ``density`` count, inner ones of longer, looser ones too; equal spans go by the greater share.
    """
    where: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        where.setdefault(w, []).append(i)
    near = {w: [i for t, at in where.items() if close(t, w) for i in at] for w in set(doc)}
    return align(weight, [(p, set(where.get(w, ())), near[w]) for p, w in enumerate(doc) if near[w]], min_words, density)[:2]


def align(weight: list[float], hits, min_words: int, density: float) -> tuple[int, float, bool]:
    """(span, share, exact) from (position in the document, item places of the same word, item places of close words), by position.

    Of the stretches that end at a word those are kept that no other with an earlier start and a better balance beats; the balance is
    the matched weight less ``density`` of all weight.  exact: some ``min_words`` words stand there one after the other, unchanged.
    """
    before = [0.0]
    for w in weight:
        before.append(before[-1] + w)
    best, exact = (0, 0.0), False
    last: dict[int, dict[int, list[tuple[int, float]]]] = {}  # position -> item place -> (start, matched)
    runs: dict[int, int] = {}
    for p, same, near in hits:
        now: dict[int, list[tuple[int, float]]] = {}
        runs = {i: runs.get(i - 1, 0) + 1 if p - 1 in last else 1 for i in same}
        exact = exact or any(r >= min_words for r in runs.values())
        for i in near:
            some = [(i, weight[i])] if i in same else []
            for q in (p - 1, p - 2):
                if q in last:
                    for j in (i - 1, i - 2):
                        some += [(start, matched + weight[i]) for start, matched in last[q].get(j, ())]
            some.sort(key=lambda s: (s[0], -s[1]))
            kept, most = [], -float("inf")
            for start, matched in some:
                balance = matched + density * before[start]
                if balance > most:
                    kept.append((start, matched))
                    most = balance
            if kept:
                now[i] = kept
            for start, matched in kept:
                span, whole = i - start + 1, before[i + 1] - before[start]
                if span >= max(min_words, best[0]) and matched >= density * whole - 1e-9:
                    best = max(best, (span, min(1.0, matched / (whole or 1.0))))
        last = {q: last[q] for q in (p - 1,) if q in last} | {p: now}
    return *best, exact


def can_hold(there, weight, size: int, density: float):
    """For each row of there[rows, words]: whether ``density`` of the weight of some ``size`` or more words in a row is there, in any order.

    there: the item's words that a word of the document is ``close`` to; what ``align`` matches is among them.
    """
    import numpy as np

    w = np.asarray(weight)
    total = np.zeros((len(there), len(w) + 1))
    np.cumsum(np.where(there, w * (1 - density), -w * density), axis=1, out=total[:, 1:])
    if len(w) < size:
        return np.zeros(len(there), bool)
    low = np.minimum.accumulate(total[:, : len(w) + 1 - size], axis=1)
    return (total[:, size:] >= low - 1e-6).any(1)


class Spellings:
    """The terms that a word is ``close`` to.  Words that are close agree but for one gap of up to two letters in each."""

    def __init__(self, terms):
        self.terms, self.gaps, self.seen = set(terms), {}, {}
        for t in self.terms:
            if len(t) >= 4 and not t.isdigit():
                for g in self._gaps(t):
                    self.gaps.setdefault(g, []).append(t)

    @staticmethod
    def _gaps(word: str) -> set[str]:
        return {f"{word[:i]}*{word[i + n :]}" for n in (0, 1, 2) for i in range(len(word) - n + 1)}

    def of(self, word: str) -> frozenset[str]:
        got = self.seen.get(word)
        if got is None:
            near = {word} & self.terms
            if len(word) >= 4 and not word.isdigit() and len(word) <= 64:
                near |= {t for g in self._gaps(word) for t in self.gaps.get(g, ()) if close(t, word)}
            elif len(word) > 64:
                near |= {t for t in self.terms if abs(len(t) - len(word)) <= 2 and close(t, word)}
            if len(self.seen) >= 1 << 17:
                self.seen.clear()
            got = self.seen[word] = frozenset(near)
        return got


def passages(items: DataFrame) -> DataFrame:
    """(item_id, words): each item's passage without stock opening sentences and closing questions."""

    def split(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["body"]):
                m = _SENTENCE.match(text.lstrip())
                lead = m.group() if m else ""
                rows.append((item, " ".join(words(lead)), text.lstrip()[len(lead) :] if lead else text, text))
            yield pd.DataFrame(rows, columns=["item_id", "lead", "rest", "body"])

    schema = "item_id bigint, lead string, rest string, body string"
    body = items.where("item_id IS NOT NULL AND item_text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").alias("body")).distinct()
    for _ in range(2):
        cut = body.mapInPandas(split, schema)
        stock = cut.where("lead <> ''").groupBy("lead").agg(F.count_distinct("rest").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("lead", F.lit(True).alias("stock"))
        body = cut.join(stock, "lead", "left").select("item_id", F.when(F.col("stock") & (F.trim("rest") != ""), F.col("rest")).otherwise(F.col("body")).alias("body"))

    def finish(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for text in pdf["body"]:
                t = plain(text).rstrip()
                while t.endswith("?"):
                    cut = max(t.rfind(c, 0, len(t) - 1) for c in ".!?\n")
                    if cut < 0:
                        break
                    t = t[: cut + 1].rstrip()
                out.append(words(t))
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": out})

    return body.mapInPandas(finish, "item_id bigint, words array<string>")


INDEX = "docs array<bigint>, terms array<string>, starts array<int>, doc array<int>, pos array<int>"


def index_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional inverted index, one row per shard of documents (``INDEX``).

    Postings starts[k] to starts[k + 1] belong to terms[k]: the documents docs[doc] at their token positions pos.  Documents
    with a NULL id and NULL or empty texts are left out.  A document lies in one shard, whole; a shard holds about
    ``SHARD_TOKENS`` tokens, or one longer document.
    """
    docs = documents.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("txt"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["docs", "terms", "starts", "doc", "pos"]
        code: dict[str, int] = {}
        ids: list[int] = []
        codes: list = []
        n = 0

        def shard():
            sizes = np.array([len(c) for c in codes])
            flat = np.concatenate(codes)
            order = np.argsort(flat, kind="stable")
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
            pos = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(code)))].astype(np.int32)
            one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t))
            return pa.RecordBatch.from_arrays(
                [one(ids, pa.int64()), one(list(code), pa.string()), one(starts, pa.int32()), one(doc[order], pa.int32()), one(pos[order], pa.int32())], names
            )

        for batch in batches:
            for doc, txt in zip(*(c.to_pylist() for c in batch.columns)):
                said = words(txt)
                if not said:
                    continue
                ids.append(doc)
                codes.append(np.fromiter((code.setdefault(w, len(code)) for w in said), np.int32, len(said)))
                n += len(said)
                if n >= SHARD_TOKENS:
                    yield shard()
                    code, ids, codes, n = {}, [], [], 0
        if n:
            yield shard()

    return docs.mapInArrow(run, INDEX)


class Passages:
    """A bounded part of the items, ready to be looked up in shards."""

    def __init__(self, known: dict[int, tuple[list[str], list[float]]], min_words: int, density: float):
        import numpy as np

        self.min_words, self.density, self.items = min_words, density, sorted(known)
        self.vocabulary = sorted({w for passage, _ in known.values() for w in passage})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = [np.array([self.number[w] for w in known[i][0]]) for i in self.items]
        self.weight = [known[i][1] for i in self.items]
        self.places: list[dict[int, list[int]]] = []
        # of what a document holds of an item's words the weight must reach the lightest stretch's share
        self.share = np.zeros((len(self.vocabulary), len(self.items)), np.float32)
        self.least = np.zeros(len(self.items), np.float32)
        for k, (ids, w) in enumerate(zip(self.ids, self.weight)):
            np.add.at(self.share[:, k], ids, w)
            total = np.r_[0, np.cumsum(w)]
            self.least[k] = density * (total[min_words:] - total[:-min_words]).min() - 1e-3
            at: dict[int, list[int]] = {}
            for p, i in enumerate(ids.tolist()):
                at.setdefault(i, []).append(p)
            self.places.append(at)
        self.spellings = Spellings(self.vocabulary)

    def look_up(self, docs, terms: list[str], starts, doc, pos):
        """(document, item, span, share, exact) of every match in a shard."""
        import numpy as np

        near = {k: sorted(self.number[t] for t in found) for k, w in enumerate(terms) if (found := self.spellings.of(w))}
        if not near:
            return
        size = [int(starts[k + 1] - starts[k]) for k in near]
        hit = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in near])
        term = np.repeat(np.array(list(near)), size)
        order = np.lexsort((pos[hit], doc[hit]))
        hit, term = hit[order], term[order]
        hit_doc, hit_pos = doc[hit], pos[hit]
        block = max(1, 20_000_000 // len(self.vocabulary))
        for d0 in range(0, len(docs), block):
            lo, hi = np.searchsorted(hit_doc, [d0, d0 + block])
            there = np.zeros((min(block, len(docs) - d0), len(self.vocabulary)), np.float32)
            same = np.full(len(terms), -1)
            for k, found in near.items():
                same[k] = found[0]
            there[hit_doc[lo:hi] - d0, same[term[lo:hi]]] = 1
            for k in (k for k, found in near.items() if len(found) > 1):
                rows = hit_doc[lo:hi][term[lo:hi] == k] - d0
                for e in near[k][1:]:
                    there[rows, e] = 1
            may = there @ self.share >= self.least
            for k in np.flatnonzero(may.any(0)):
                rows = np.flatnonzero(may[:, k])
                rows = rows[can_hold(there[rows][:, self.ids[k]] > 0, self.weight[k], self.min_words, self.density)]
                at = self.places[k]
                for d in rows + d0:
                    a, b = np.searchsorted(hit_doc, [d, d + 1])
                    hits = []
                    for p, t in zip(hit_pos[a:b].tolist(), term[a:b].tolist()):
                        close_by = [i for e in near[t] for i in at.get(e, ())]
                        if close_by:
                            hits.append((p, set(at.get(self.number.get(terms[t], -1), ())), close_by))
                    span, share, exact = align(self.weight[k], hits, self.min_words, self.density)
                    if span:
                        yield int(docs[d]), self.items[k], span, share, exact


def search_index(index: DataFrame, items: DataFrame, min_words: int = 15, density: float = 0.85) -> DataFrame:
    """(doc, item_id, span, share, match): what of the items stands in the indexed documents.

    At least ``min_words`` words of the passage in order, of whose weight at least ``density`` matches; a word weighs the more the
    fewer items use it, so writing that shares only the items' style falls short.  match: 'phrase' if so many words stand there
    unchanged one after the other, else 'proximity'.
    """
    spark = index.sparkSession
    texts = cut_lineage(passages(items).where(F.size("words") >= min_words))
    places = texts.select("item_id", F.posexplode("words").alias("ipos", "term"))
    terms = places.groupBy("term").agg(F.count_distinct("item_id").alias("used"))
    total = F.lit(float(texts.count()))
    weighed = places.join(terms, "term").select("item_id", F.struct("ipos", "term", F.log1p(total / F.col("used")).alias("weight")).alias("w"))
    passage = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list("w")).alias("w")).select(
        "item_id", F.col("w.term").alias("words"), F.col("w.weight").alias("weight")
    )
    passage = cut_lineage(passage)
    # an eval set of ordinary size is one part; a huge one is gone through part by part
    parts = max(1, -(-passage.select(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] // MAX_WORDS))
    schema = "doc bigint, item_id bigint, span bigint, share double, match string"

    def look_up(held):
        def run(batches):
            import pyarrow as pa

            known = Passages(held.value, min_words, density) if held.value else None
            for batch in batches:
                rows = []
                for r in range(batch.num_rows if known else 0):
                    col = lambda i: batch.column(i)[r].values  # noqa: B023, E731
                    for d, i, span, share, exact in known.look_up(ints(col(0)), col(1).to_pylist(), ints(col(2)), ints(col(3)), ints(col(4))):
                        rows.append((d, i, span, share, "phrase" if exact else "proximity"))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc", "item_id", "span", "share", "match"])

        return run

    found = None
    for part in range(parts):
        mine = passage.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        held = spark.sparkContext.broadcast({r.item_id: (r.words, r.weight) for r in mine})
        got = index.mapInArrow(look_up(held), schema)
        found = got if found is None else found.unionByName(got)
    return found.groupBy("doc", "item_id").agg(F.max("span").alias("span"), F.max("share").alias("share"), F.min("match").alias("match"))


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 15, density: float = 0.85) -> DataFrame:
    """(doc_id, item_id, span, share, match): documents that hold at least ``min_words`` words of an item's passage in order.

    The documents' index is written to the shared folder, then looked up (``search_index``).  Documents with NULL or empty text and
    items without a passage match nothing; items that share a passage are reported each; repeated rows count once.
    """
    return search_index(cut_lineage(index_corpus(documents, doc_id, text)), items, min_words, density).withColumnRenamed("doc", doc_id)
