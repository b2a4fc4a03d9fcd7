"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Short texts are encoded whole, batch by batch.  Texts above ``long_text`` bytes are cut into parts of at most half that size that many tasks
encode: between pre-tokens where there is a boundary, so nothing changes there, and anywhere inside a
pre-token that is itself too long.  Such fragments are joined again as a tree: the tokens around each join are
encoded anew in a growing window until the window's first and last token agree with both sides.  A token
sequence is the vocabulary's encoding exactly if every neighbouring pair is stable, so agreement proves the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ordering import spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# fixed value: the pre-token pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict = {}


def load(path: str):
    """The encoder, read once in each Python worker."""
    if path not in _LOADED:
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path] = enc, {i: b for b, i in ranks.items()}, regex.compile(PATTERN)
    return _LOADED[path]


PLAIN, FIRST, NEXT = 0, 1, 2  # kinds of parts: whole pre-tokens; first or later fragment of a giant pre-token


def cut(text: str, limit: int, pattern) -> list[tuple[bytes, int]]:
    """(bytes, kind) parts of at most ``limit`` bytes (white space before a cut moves to the next part), in order."""
    parts: list[tuple[bytes, int]] = []
    held: list[str] = []
    size = 0

    def flush(giant: bool):
        # white space splits differently at the end of a text, so no plain part may end with it
        nonlocal held, size
        n = len(held)
        while n and held[n - 1][-1].isspace():
            n -= 1
        if n:
            parts.append(("".join(held[:n]).encode(), PLAIN))
        held = held[n:]
        if giant:
            parts.extend((w.encode(), FIRST) for w in held)
            held = []
        size = sum(len(w.encode()) for w in held)

    for m in pattern.finditer(text):
        w = m.group()
        b = w.encode()
        if len(b) > limit:
            flush(True)
            parts += [(b[i : i + limit], NEXT if i else FIRST) for i in range(0, len(b), limit)]
            continue
        if held and size + len(b) > limit:
            flush(False)
        held.append(w)
        size += len(b)
    if held:
        parts.append(("".join(held).encode(), PLAIN))
    return parts


def encode_part(part: bytes, kind: int, enc) -> list[int]:
    return enc.encode_ordinary(part.decode()) if kind == PLAIN else list(enc._core_bpe.encode_single_piece(part))


def join(a: list[int], b: list[int], enc, back) -> list[int]:
    """Encoding of one unsplit run from the encodings of its halves."""
    w = 2
    while True:
        wa, wb = min(w, len(a)), min(w, len(b))
        window = b"".join(back[i] for i in a[len(a) - wa :] + b[:wb])
        mid = list(enc._core_bpe.encode_single_piece(window))
        left = wa == len(a) or mid[0] == a[len(a) - wa]
        right = wb == len(b) or mid[-1] == b[wb - 1]
        if left and right:
            return a[: len(a) - wa] + mid + b[wb:]
        w *= 2


def join_tree(parts: list[list[int]], enc, back) -> list[int]:
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2], enc, back) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def assemble(parts: list[tuple[int, list[int]]], enc, back) -> list[int]:
    """Token ids of a text from the (kind, ids) of its parts in order."""
    out: list[int] = []
    run: list[list[int]] = []
    for kind, ids in parts:
        if kind != NEXT and run:
            out += join_tree(run, enc, back)
            run = []
        if kind == PLAIN:
            out += ids
        else:
            run.append(ids)
    return out + (join_tree(run, enc, back) if run else [])


def encode_corpus(df: DataFrame, doc_id: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", long_text: int = 8192) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens.

    NULL and empty texts have an empty list.  Strings that name special tokens are ordinary text.  A row that
    stands several times comes out as often.  ``long_text``: bytes above which a text is cut into parts.
    """
    rows = df.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("txt"))
    size = F.coalesce(F.octet_length("txt"), F.lit(0))
    kind = df.schema[doc_id].dataType.simpleString()

    def whole(batches):
        import pyarrow as pa

        enc, _, _ = load(path)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc", "ids"])

    def to_parts(batches):
        import pyarrow as pa

        _, _, pattern = load(path)
        for batch in batches:
            for i in range(batch.num_rows):
                pieces = cut(batch.column(2)[i].as_py(), long_text // 2, pattern)
                for s in range(0, len(pieces), 64):
                    some = pieces[s : s + 64]
                    repeat = pa.array([i] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(repeat), batch.column(1).take(repeat), pa.array(range(s, s + len(some)), pa.int64()),
                            pa.array([k for _, k in some], pa.int32()), pa.array([b for b, _ in some], pa.binary()),
                        ],
                        ["line", "doc", "part", "kind", "bytes"],
                    )

    def encode_parts(batches):
        import pyarrow as pa

        enc, _, _ = load(path)
        for batch in batches:
            ids = [encode_part(b, k, enc) for b, k in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32()))], ["line", "doc", "part", "kind", "ids"])

    def join_parts(batches):
        import pyarrow as pa

        enc, back, _ = load(path)
        for batch in batches:
            ids = [assemble([(p["kind"], p["ids"]) for p in parts], enc, back) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc", "ids"])

    out = f"doc {kind}, ids array<int>"
    short = rows.where(size <= long_text).mapInArrow(whole, out)
    long = rows.where(size > long_text).select(F.monotonically_increasing_id().alias("line"), "doc", "txt")
    parts = long.mapInArrow(to_parts, f"line bigint, doc {kind}, part bigint, kind int, bytes binary")
    encoded = spread(parts, "line", "part").mapInArrow(encode_parts, f"line bigint, doc {kind}, part bigint, kind int, ids array<int>")
    # one text's parts meet again here; the list is no larger than the text's own result row
    texts = encoded.groupBy("line").agg(F.first("doc").alias("doc"), F.sort_array(F.collect_list(F.struct("part", "kind", "ids"))).alias("parts"))
    return short.unionByName(texts.select("doc", "parts").mapInArrow(join_parts, out)).withColumnRenamed("doc", doc_id)
