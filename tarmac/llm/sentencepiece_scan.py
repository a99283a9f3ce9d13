"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A BPE segmentation is the one path through the lattice of vocabulary pieces on which every two
neighbours are compatible: encoding the two pieces' text alone gives these two pieces. So the
encoding is a best path with weights 0 (compatible) and minus infinity, and it can be cut
anywhere. The state at a cut is the last piece that begins before it, and how far it reaches
over it.

1. A giant text is cut every ``chunk`` characters, in the middle of words too. Each chunk, with a
   piece's length of text around it, yields its transfer matrix: which state at its end can
   follow which state at its beginning. Within a chunk no piece crosses the beginning of a
   word or a line end (checked on the vocabulary), so the matrix needs the lattice only up to
   the first and from the last such point; a chunk without one is walked whole.
2. The matrices of a text, a few states wide, are combined by an associative product; prefix and
   suffix products leave one state at each cut.
3. With both its states known, each chunk is encoded (backtraced) and decoded by itself.

Texts of one chunk need no cut. Words are encoded once per task and remembered (bounded).

Null text: null ids, no pieces. Empty text: no pieces. Decoding gives a text back exactly but for
U+2581, which the vocabulary uses for the blank: ``round_trip`` is then false. Rows that repeat a
doc_id are encoded each by its own text. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import stored

MODEL = "piece_bpe_32k.model"
CHUNK = 16_384
BLANK = "▁"
BATCH = 256  # texts in an output batch
FRESH = ("", 0)  # the state at a position that no piece crosses


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Model:
    """The vocabulary, its merges, and a word cache."""

    def __init__(self, path: str):
        import sentencepiece
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.pieces = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.out = [b""] * size
        for p, i in self.pieces.items():
            self.out[i] = p.replace(BLANK, " ").encode()
        for b, i in self.byte_ids.items():
            self.out[i] = bytes([b])
        if any(re.search(f"[^{BLANK}]{BLANK}", p) or "\n" in p for p in self.pieces):
            raise ValueError("a piece goes on over the beginning of a word or a line end")
        self.cache: dict[str, list[int]] = {}
        self.compatible = lru_cache(1 << 16)(self._compatible)

    #: words with the blanks before them; line ends by themselves
    UNITS = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")

    def unit(self, unit: str) -> list[int]:
        ids = self.cache.get(unit)
        if ids is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            if unit == "\n":
                ids = [self.byte_ids[10]]
            elif unit[0] == BLANK:
                ids = self.sp.encode(unit[1:].replace(BLANK, " ")) if len(unit) > 1 else [self.pieces[BLANK]]
            else:
                ids = self.sp.encode("\n" + unit)[2:]
            self.cache[unit] = ids
        return ids

    def encode(self, marked: str) -> list[int]:
        ids: list[int] = []
        unit = self.unit
        for u in self.UNITS.findall(marked):
            ids += unit(u)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")

    def ids_of(self, piece: str) -> list[int]:
        return [self.pieces[piece]] if piece in self.pieces else [self.byte_ids[b] for b in piece.encode()]

    def merged(self, text: str) -> list[str]:
        """Merges of neighbours, best score first, from single characters."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1)
                     if parts[i] + parts[i + 1] in self.score]
            if not found:
                break
            i = -max(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def starts(self, text: str, at: int) -> Iterator[str]:
        """Pieces that begin at a position; a character outside the vocabulary is a piece by itself."""
        yield text[at]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            if text[at:at + n] in self.pieces:
                yield text[at:at + n]

    # ---- the lattice ----

    def states(self, text: str, cut: int) -> list[tuple[str, int]]:
        """States at a cut: pieces that begin before it and end at it or beyond, with their reach."""
        return [(p, s + len(p) - cut) for s in range(max(0, cut - self.longest), cut) for p in self.starts(text, s)
                if s + len(p) >= cut]

    def walk(self, text: str, begin: int, end: int, first: tuple[str, int] | None) -> dict[tuple[str, int], list[str]]:
        """Best paths from a state at ``begin`` (None: a fresh start) to each state at ``end``: the pieces
        that begin in [begin, end)."""
        last, reach = (None, 0) if first is None or first == FRESH else first
        at = begin + reach
        if at >= end:
            return {(last or "", at - end): []}
        reached: dict[int, dict] = {at: {last: None}}
        done: dict[tuple[str, int], tuple] = {}
        back: dict[tuple[int, str], tuple] = {}
        for pos in range(at, end):
            for before in reached.pop(pos, {}):
                for piece in self.starts(text, pos):
                    if before is not None and not self.compatible(before, piece):
                        continue
                    to = pos + len(piece)
                    if (to, piece) in back:
                        continue
                    back[to, piece] = (pos, before)
                    if to >= end:
                        done[piece, to - end] = (to, piece)
                    else:
                        reached.setdefault(to, {})[piece] = None
        paths = {}
        for state, (to, piece) in done.items():
            path = []
            while piece is not None and to > at:
                path.append(piece)
                to, piece = back[to, piece]
            paths[state] = path[::-1]
        return paths

    def is_fresh(self, text: str, at: int) -> bool:
        """Whether a unit begins at a position, so that no piece crosses it."""
        return (at in (0, len(text)) or text[at] == "\n" or text[at - 1] == "\n"
                or text[at] == BLANK and text[at - 1] != BLANK)

    def fresh_points(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last fresh position in [begin, end], if there is one."""
        head = next((x for x in range(begin, end + 1) if self.is_fresh(text, x)), None)
        if head is None:
            return None
        return head, next(x for x in range(end, head - 1, -1) if self.is_fresh(text, x))

    def cut_states(self, text: str, cut: int) -> list[tuple[str, int]]:
        return [FRESH] if self.is_fresh(text, cut) else self.states(text, cut)

    def transfer(self, text: str, begin: int, end: int) -> list[tuple]:
        """The chunk's matrix, by its finite entries: (state at its beginning, state at its end)."""
        ins, points = self.cut_states(text, begin), self.fresh_points(text, begin, end)
        if points is None:
            return [(s, o) for s in ins for o in self.walk(text, begin, end, s)]
        head, tail = points
        alive = ins if head == begin else [
            s for s in ins if any(o[1] == 0 for o in self.walk(text, begin, head, s))]
        outs = [FRESH] if tail == end else list(self.walk(text, tail, end, None))
        return [(s, o) for s in alive for o in outs]

    def between(self, text: str, begin: int, end: int, first: tuple[str, int], last: tuple[str, int]) -> list[int]:
        """Backtrace of a chunk from its two states: ids of the pieces that begin in it."""
        points = self.fresh_points(text, begin, end)
        if points is None:
            return self._ids(self.walk(text, begin, end, first)[last])
        head, tail = points
        ids: list[int] = []
        if head > begin:
            ids += self._ids(next(p for s, p in self.walk(text, begin, head, first).items() if s[1] == 0))
        ids += self.encode(text[head:tail])
        return ids + (self._ids(self.walk(text, tail, end, None)[last]) if tail < end else [])

    def _ids(self, path: list[str]) -> list[int]:
        return [i for piece in path for i in self.ids_of(piece)]


def compose(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two transfer matrices given by their finite entries; associative."""
    rows: dict = {}
    for s, o in b:
        rows.setdefault(s, []).append(o)
    return list(dict.fromkeys((s, o) for s, m in a for o in rows.get(m, ())))


def states_at_cuts(matrices: list[list[tuple]]) -> list[tuple[str, int]]:
    """The state at every cut of a text, from its chunks' matrices: what prefix and suffix products share."""
    ahead = [matrices[0]]
    for m in matrices[1:]:
        ahead.append(compose(ahead[-1], m))
    back = [matrices[-1]]
    for m in matrices[-2::-1]:
        back.append(compose(m, back[-1]))
    back.reverse()
    cuts = [FRESH]
    for k in range(1, len(matrices)):
        on = {o for _, o in ahead[k - 1]} & {s for s, _ in back[k]}
        if len(on) != 1:
            raise ValueError(f"{len(on)} states at a cut")
        cuts.append(on.pop())
    return [*cuts, FRESH]


# ---- Spark ----

CHUNKS = "doc_id bigint, text_hash bigint, no int, before string, body string, after string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("no", pa.int32()),
                      ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
ENCODED = "doc_id bigint, text_hash bigint, no int, ids array<int>, round_trip boolean"


def _marked(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def _encoded_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, text_hash, no, ids, same = zip(*rows)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(no, pa.int32()),
                            pa.ListArray.from_arrays(offsets, flat), pa.array(same)], schema=_ENCODED)


def encode_whole(rows: DataFrame, path: str) -> DataFrame:
    """Texts of one chunk: ``doc_id, text_hash, no, ids, round_trip``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            out = []
            for doc, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                ids = model.encode(_marked(text))
                out.append((doc, text_hash, 0, ids, model.decode(ids)[1:] == text))
                if len(out) == BATCH:
                    yield _encoded_batch(out)
                    out = []
            if out:
                yield _encoded_batch(out)

    return rows.mapInArrow(run, ENCODED)


def chunks_of(rows: DataFrame, chunk: int, around: int) -> DataFrame:
    """Chunks of giant texts, each with the text around it, dealt out by (document, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                t = _marked(text)
                for group in range(0, len(t), chunk * 64):
                    at = range(group, min(len(t), group + chunk * 64), chunk)
                    yield pa.record_batch([
                        pa.array([doc] * len(at), pa.int64()), pa.array([text_hash] * len(at), pa.int64()),
                        pa.array([b // chunk for b in at], pa.int32()), pa.array([t[max(0, b - around):b] for b in at]),
                        pa.array([t[b:b + chunk] for b in at]), pa.array([t[b + chunk:b + chunk + around] for b in at])],
                        names=["doc_id", "text_hash", "no", "before", "body", "after"])

    return rows.mapInArrow(run, CHUNKS).repartition("doc_id", "text_hash", "no")


def transfer_matrices(chunks: DataFrame, path: str) -> DataFrame:
    """``doc_id, text_hash, no, entries``: each chunk's transfer matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            entries = []
            for before, body, after in zip(*(batch.column(c).to_pylist() for c in ("before", "body", "after"))):
                found = model.transfer(before + body + after, len(before), len(before) + len(body))
                entries.append([{"s": s[0], "sr": s[1], "o": o[0], "or": o[1]} for s, o in found])
            kind = pa.list_(pa.struct([("s", pa.string()), ("sr", pa.int32()), ("o", pa.string()), ("or", pa.int32())]))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "text_hash", "no")), pa.array(entries, kind)],
                                  names=["doc_id", "text_hash", "no", "entries"])

    return chunks.mapInArrow(
        run, "doc_id bigint, text_hash bigint, no int, entries array<struct<s:string,sr:int,o:string,`or`:int>>")


def combine(matrices: DataFrame) -> DataFrame:
    """``doc_id, text_hash, no, s, sr, o, or``: the states of each chunk. Holds one text's matrices at a time."""
    kind = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("k", pa.int32()), ("s", pa.string()), ("sr", pa.int32()),
                      ("o", pa.string()), ("or", pa.int32())])

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        cuts = states_at_cuts([[((e["s"], e["sr"]), (e["o"], e["or"])) for e in r[3]] for r in rows])
        out = [(*r[:3], *cuts[i], *cuts[i + 1]) for i, r in enumerate(rows)]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "no", "entries"))):
                if rows and row[:2] != rows[0][:2]:
                    yield solved(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solved(rows)

    return (matrices.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "no")
            .mapInArrow(run, "d bigint, t bigint, k int, s string, sr int, o string, `or` int"))


def encode_chunks(chunks: DataFrame, states: DataFrame, path: str) -> DataFrame:
    """Each chunk by itself, between its two states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        names = ("doc_id", "text_hash", "no", "before", "body", "after", "s", "sr", "o", "or")
        for batch in batches:
            out = []
            for doc, text_hash, no, before, body, after, s, sr, o, o_r in zip(*(batch.column(c).to_pylist() for c in names)):
                text, begin, end = before + body + after, len(before), len(before) + len(body)
                ids = model.between(text, begin, end, (s, sr), (o, o_r))
                out.append((doc, text_hash, no, ids, model.decode(ids) == text[begin + sr:end + o_r].replace(BLANK, " ")))
                if len(out) == BATCH:
                    yield _encoded_batch(out)
                    out = []
            if out:
                yield _encoded_batch(out)

    on = (chunks["doc_id"].eqNullSafe(states["d"]) & (chunks["text_hash"] == states["t"]) & (chunks["no"] == states["k"]))
    return chunks.join(states, on).drop("d", "t", "k").mapInArrow(run, ENCODED)


def encode(documents: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every row."""
    path = path or model_path()
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    long = F.char_length("text") + 1 > chunk
    whole = encode_whole(rows.where(~long), path).select("doc_id", "ids", "round_trip")
    giants = rows.where(long)
    copies = giants.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    chunks = stored(chunks_of(giants, chunk, Model(path).longest).dropDuplicates(["doc_id", "text_hash", "no"]), "chunks")
    parts = encode_chunks(chunks, combine(transfer_matrices(chunks, path)), path)
    joined = parts.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"), F.every("round_trip").alias("round_trip"))
    joined = joined.join(copies, joined["doc_id"].eqNullSafe(copies["d"]) & (joined["text_hash"] == copies["t"]))
    long_rows = joined.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids"), "round_trip",
                              F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")
    empty = rows.where("text IS NULL").select("doc_id", F.lit(None).cast("array<int>").alias("ids"),
                                              F.lit(None).cast("boolean").alias("round_trip"))
    out = whole.unionByName(long_rows).unionByName(empty)
    return out.select("doc_id", F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_pieces"), "ids", "round_trip")
