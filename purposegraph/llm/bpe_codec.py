"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answered, collected, exchanged, expanded, fields, grouped, packed, parts_of, ranked, squeezed, stored, unfields, unpacked
from .bpe import ByteLevel, Merges, coded, gathered


def split_blocks(docs: DataFrame, path: str, pattern: str, parts: int, text: str = "text") -> DataFrame:
    """(block, payload, part, blob): for each block one row with its texts as word numbers, and one for each part with the block's distinct words there."""

    def run(batches):
        split, block = ByteLevel(path, pattern), TaskContext.get().partitionId() << 32
        for ids, texts in collected(batches):
            words, flat, sizes = coded([[w.encode() for w in split.words(t)] for t in texts])
            order, flat = ranked(flat, len(words))
            words = [words[i] for i in order]
            place = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), dtype=np.int64, count=len(words))
            joint = np.empty(len(words), dtype=np.int64)  # a word's place among the answers of all parts
            joint[np.argsort(place, kind="stable")] = np.arange(len(words))
            missing = np.fromiter((i is None for i in ids), dtype=bool, count=len(ids))
            doc_ids = np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64)
            payload = fields(squeezed(doc_ids), squeezed(missing), squeezed(sizes), squeezed(flat), squeezed(joint))
            asked = [(p, packed([words[i] for i in at])) for p, at in grouped(place)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (1 + len(asked)), pa.int64()), pa.array([payload] + [None] * len(asked), pa.binary()), pa.array([None] + [p for p, _ in asked], pa.int32()), pa.array([None] + [b for _, b in asked], pa.binary())],
                names=["block", "payload", "part", "blob"],
            )
            block += 1

    source = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, "block long, payload binary, part int, blob binary")


def encode_words(path: str, pattern: str):
    """The answer of a part of the vocabulary: every distinct word is encoded once, whatever the number of blocks that ask."""

    def answer(blobs: list[bytes]) -> list[bytes]:
        asked = [unpacked(b) for b in blobs]
        words, flat, sizes = coded(asked)
        merges, special = Merges(path), ByteLevel(path, pattern).special
        counts, ids = merges.run(words)
        for text, token in special.items():
            if text.encode() in words:
                at = words.index(text.encode())
                first = int(counts[:at].sum())
                ids = np.concatenate([ids[:first], [token], ids[first + counts[at] :]])
                counts[at] = 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return [fields(squeezed(counts[mine]), squeezed(gathered(mine, counts, ids))) for mine in (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]

    return answer


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids) for every text, or with digest (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Texts are split into words once; blocks of them are kept in the shared folder as word numbers. The distinct words
    of each block meet by hash in parts of the vocabulary, where each distinct word is encoded once, and the ids come
    back to the block and are put at the words' positions. Nothing is broadcast and no word is a hot key.

    Null text counts as empty (no ids). doc_id may be null or repeated; each row has its own result. Special
    strings inside texts become their ids, as by the library's default. An empty table gives an empty result.
    """
    parts = parts_of(docs)
    table = stored(split_blocks(docs, path, pattern, parts, text), parts)
    ids = exchanged(table.where("payload is null").select("block", "part", "blob"), encode_words(path, pattern), parts)
    blocks = answered(table.where("payload is not null").select("block", "payload"), parts, ids)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>"

    def run(batches):
        pieces = piece_table(path) if digest else None
        for batch in batches:
            for payload, answers in zip(batch.column(1), batch.column(2), strict=True):
                doc_ids, missing, sizes, flat, joint = map(expanded, unfields(payload.as_py()))
                got = [list(map(expanded, unfields(a))) for a in answers.as_py() or []]
                counts = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.int64)
                every = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.int64)
                at = joint[flat]
                total = np.concatenate([[0], np.cumsum(counts[at])])
                ends = total[np.cumsum(sizes)]
                tokens = gathered(at, counts, every)
                mine = np.split(tokens, ends[:-1])
                names = pa.array([None if m else i for i, m in zip(doc_ids.astype(np.uint64).view(np.int64).tolist(), missing.tolist(), strict=True)], pa.int64())
                if digest:
                    sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in mine]
                    back = [hashlib.sha256(decoded(x, *pieces).encode()).hexdigest() for x in mine]
                    yield pa.RecordBatch.from_arrays([names, pa.array(list(map(len, mine)), pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([names, pa.array([x.astype(np.int32) for x in mine], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.select("block", "payload", "a0").mapInArrow(run, schema)


def piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of the pieces by id: the vocabulary's own bound, whatever the corpus."""
    pieces = Merges(path).pieces
    each = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    return np.fromiter(map(len, each), dtype=np.int64, count=len(each)), np.frombuffer(b"".join(each), dtype=np.uint8)


def decoded(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> str:
    """The text of ids by joining each to its piece in the table; bytes that are no UTF-8 become replacement characters."""
    known = ids[(ids >= 0) & (ids < len(sizes))]
    return gathered(known, sizes, flat).tobytes().decode("utf-8", errors="replace") if len(known) else ""


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with text: the decoded ids. Ids outside the vocabulary add nothing; null ids give null. A map without shuffle."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != text], T.StructField(text, T.StringType())])

    def run(batches):
        pieces = piece_table(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [None if x is None else decoded(np.array([i for i in x if i is not None], dtype=np.int64), *pieces) for x in batch.column(at).to_pylist()]
            keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text]
            yield pa.RecordBatch.from_arrays([*[c for _, c in keep], pa.array(texts, pa.string())], names=[*[n for n, _ in keep], text])

    return rows.mapInArrow(run, schema)
