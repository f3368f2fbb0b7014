"""Best-fit packing of documents into fixed-size bins under conflicts.

Documents are dealt by a hash of their id to shards of a bounded size. In a
shard, longest first, each piece goes into the bin with the least room that
takes it: bins stand in order of room, each with one bit for every source and
every duplicate cluster it holds, and the search goes on to the next roomier
bin until one shares no bit with the piece; else a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens in a bin, and documents aimed at in a shard.
CAPACITY, SHARD_DOCS = 2048, 2048


def word_tokens(text: str = "text") -> F.Column:
    """Words of a text and one separator; a null text has the separator alone."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # A word starts where a non-space follows a space or the start.
    spaced = F.translate(whole, "\t\n\x0b\f\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda x: x != "")).cast("long") + 1


def pack(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, room taken before) of each (size, bits) piece, in the given order."""
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    bits: list[int] = []
    out = []
    for size, own in pieces:
        i = bisect_left(rooms, (size, -1))
        while i < len(rooms) and bits[rooms[i][1]] & own:
            i += 1
        if i < len(rooms):
            room, b = rooms.pop(i)
            bits[b] |= own
        else:
            room, b = capacity, len(bits)
            bits.append(own)
        insort(rooms, (room - size, b))
        out.append((b, capacity - room))
    return out


def best_fit(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", source: str = "source", cluster: F.Column | None = None, tokens: F.Column | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(id, piece, n_pieces, n_tokens, token_start, bin_id, bin_offset) of each piece of each row.

    ``tokens`` is the number of tokens of a row, by default its words and one
    separator; a column of a tokenizer's counts may stand there. A text longer
    than a bin is cut into full bins of its own and a rest, all of it packed:
    tokens ``token_start`` to ``token_start + n_tokens`` of the text lie from
    ``bin_offset`` on. Pieces of one bin have different sources and duplicate
    clusters (by default: the words of the lower-cased text in order); a null
    source conflicts with nothing. Empty and null texts are one separator;
    an empty table has no bins. Repeated rows are pieces
    of their own, kept apart by their cluster. Bins never span shards; equal
    sizes go by id.
    """
    cluster = cluster if cluster is not None else F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+", " ")))
    tokens = tokens if tokens is not None else word_tokens(text)
    n = df.count()
    shards = max(1, -(-n // shard_docs))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), cluster.alias("cluster"), tokens.cast("long").alias("n"),
    ).withColumn("shard", F.pmod(F.xxhash64("id", "cluster"), F.lit(shards)).cast("int"))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, n_pieces int, n_tokens long, shard int, bin int, bin_offset long"

    def run(t: pa.Table) -> pa.Table:
        got = t.select(["id", "source", "cluster", "n"]).to_pylist()
        got.sort(key=lambda r: (-r["n"], r["id"] is None, r["id"] if r["id"] is not None else 0, r["cluster"], r["source"] or ""))
        bit: dict = {}
        pieces = []
        for r in got:
            full, rest = divmod(r["n"], capacity)
            sizes = [capacity] * full + [rest] * (rest > 0)
            own = 0
            for key in (("s", r["source"]) if r["source"] is not None else None, ("c", r["cluster"])):
                if key is not None:
                    own |= 1 << bit.setdefault(key, len(bit))
            pieces += [(size, own, r["id"], k, len(sizes)) for k, size in enumerate(sizes)]
        pieces.sort(key=lambda p: -p[0])
        # Full pieces fill bins alone and need no search.
        whole = sum(p[0] == capacity for p in pieces)
        places = [(b, 0) for b in range(whole)] + [(b + whole, o) for b, o in pack([p[:2] for p in pieces[whole:]], capacity)]
        shard = t["shard"][0].as_py()
        cols = [[p[2] for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], [p[0] for p in pieces], [shard] * len(pieces), [b for b, _ in places], [o for _, o in places]]
        names = ["id", "piece", "n_pieces", "n_tokens", "shard", "bin", "bin_offset"]
        types = [t.schema.field("id").type, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, types)], names=names)

    made = rows.groupBy("shard").applyInArrow(run, schema)
    return made.select(F.col("id").alias(id_col), "piece", "n_pieces", "n_tokens", (F.col("piece").cast("long") * capacity).alias("token_start"), (F.col("shard").cast("long") * (1 << 32) + F.col("bin")).alias("bin_id"), "bin_offset")
