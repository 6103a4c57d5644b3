"""SentencePiece encoding and decoding, exact, with giant documents split over tasks.

The model is a BPE: its encoding of a text is the one path of pieces on which no two neighbours would have been merged across
their border. So a path's weight is a max-plus sum, of piece scores where two neighbours may stand together and of minus
infinity where they may not, and the state at a position is the piece that ends there. A giant document is cut at fixed places. For each
chunk a transfer matrix tells which state after the chunk follows from which state before it, a state being the piece that
spans or ends at a cut and how far it reaches; matrices are combined associatively from both ends, which leaves one
state at each cut, and then every chunk finds its own path.

No piece spans a blank that follows something else, so a text falls into units at whose borders there is only one state, and the
matrix of a chunk comes from its first and last unit alone. Distinct units are encoded, in alphabetic order, so that what two
begin with alike is worked out once, and kept; texts are then numbers of units, looked up in one array.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import free_name, save, shield
from callweave.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # the driver reads it; tasks get the table of pieces
CHUNK = 1 << 16  # code points of a chunk; a longer text is split
KEPT_UNITS = 700_000  # encoded units a worker keeps; beyond that it forgets them
BLOCK = 1 << 21  # code points of the texts encoded at a time: bounds memory, never the result
SPACE = "▁"  # stands for a blank in pieces; in a text it is spelled in bytes, so that decoding is exact
UNIT = re.compile(rf" *[^ \n{SPACE}]+| +|[\n{SPACE}]")
BARRIER = "\n" + SPACE  # never part of a piece
BORDER = (0, "")  # the state at a border of units, and before a text


@dataclass
class Pieces:
    """Pieces of a BPE model with byte fallback, and what is worked out about them on the way."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    longest: int = 0
    spines: dict[str, tuple] = field(default_factory=dict, repr=False)
    pairs: dict[str, dict[str, bool]] = field(default_factory=dict, repr=False)
    units: dict[str, int] = field(default_factory=dict, repr=False)  # numbers of units

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        self.spelled = {i: p for p, i in self.ids.items()}
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.shown = {i: p.replace(SPACE, " ") for i, p in self.spelled.items()} | {self.byte_ids[b]: chr(b) for b in range(128)}
        self.tails = {piece[k:]: False for piece in self.ids for k in range(1, len(piece))}  # whether what pieces end with is one
        self.heads = {piece[:k] for piece in self.ids for k in range(1, len(piece) + 1)}
        self.tails.update(dict.fromkeys(self.ids, True))
        self.forget()

    def forget(self) -> None:
        """The kept units: for each number its ids in ``flat``, its characters, and whether its ids decode to it."""
        self.units.clear()
        self.pairs.clear()
        self.flat, self.starts, self.widths, self.exact = array("i"), array("q", [0]), array("i"), bytearray()

    def merged(self, text: str, left: int = 1) -> list[str]:
        """Merge the best pair, the first of equal ones, until ``left`` symbols are left or nothing merges."""
        symbols = list(text)
        while len(symbols) > left:
            best = max(
                ((self.scores[p], -k) for k in range(len(symbols) - 1) if (p := symbols[k] + symbols[k + 1]) in self.scores), default=None
            )
            if best is None:
                break
            k = -best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def spine(self, piece: str) -> tuple[list, list] | None:
        """The symbols at the right and at the left edge of a piece while it was merged, each with the score of the merge
        that took it in. None for a piece that merging does not give."""
        if piece not in self.spines:
            sides: tuple[list, list] | None = ([], [])
            if len(piece) > 1 and self.merged(piece) != [piece]:
                sides = None
            else:
                for side in (0, 1):
                    part, taken_in = piece, float("-inf")
                    while True:
                        sides[side].append((part, taken_in))
                        if len(part) == 1:
                            break
                        a, b = self.merged(part, 2)
                        part, taken_in = (b if side == 0 else a), self.scores[part]
            self.spines[piece] = sides
        return self.spines[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart. A piece not in the model (a character spelled in bytes, or the start) never merges."""
        if left not in self.ids or right not in self.ids:
            return True
        after = self.pairs.setdefault(left, {})
        known = after.get(right)
        if known is None:
            a, b = self.spine(left), self.spine(right)
            known = a is not None and b is not None
            if known:
                known = not any(self.joins(x, x_in, b[1]) for x, x_in in a[0] if x + right[0] in self.heads)
            after[right] = known
        return known

    def joins(self, x: str, x_in: float, others: list[tuple[str, float]]) -> bool:
        """Whether ``x`` would have been merged with one of the others that stand after it at some time."""
        for y, y_in in others:
            score = self.scores.get(x + y)
            if score is not None and score > x_in and score >= y_in:  # of equal merges the one to the left comes first
                return True
        return False

    def arcs(self, text: str, at: int) -> Iterator[str]:
        """What can stand at a place: pieces, or the character itself where it has to be spelled in bytes."""
        if text[at] not in self.ids:
            yield text[at]
            return
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            if piece in self.ids and self.spine(piece) is not None:
                yield piece

    def forward(self, text: str, entries: dict[tuple[int, str], object], end: int) -> dict[int, dict[str, tuple]]:
        """Max-plus: for each place, from the entries on, the pieces that may end there, each with its best weight, the piece
        before it and the entry it comes from. Places at or past ``end`` are reached and not left."""
        table: dict[int, dict[str, tuple]] = {}
        for (place, piece), origin in entries.items():
            table.setdefault(place, {})[piece] = (0.0, None, origin)
        for place in range(min(table, default=end), end):
            held = table.get(place)
            if not held:
                continue
            for piece in self.arcs(text, place):
                gain = self.scores.get(piece, 0.0)
                best = max(((w + gain, prev, o) for prev, (w, _, o) in held.items() if self.may_follow(prev, piece)), key=lambda x: x[0], default=None)
                if best is not None:
                    table.setdefault(place + len(piece), {})[piece] = best
        return table

    def back(self, table: dict, place: int, piece: str) -> list[str]:
        out = []
        while True:
            _, before, _ = table[place][piece]
            if before is None:
                return out[::-1]
            out.append(piece)
            place, piece = place - len(piece), before

    def path(self, text: str, entry: tuple[int, str], leave: tuple[int, str] | None) -> list[str]:
        """The pieces from ``entry`` to ``leave`` (``None``: the best at the end of the text)."""
        end = leave[0] if leave else len(text)
        table = self.forward(text, {entry: 0}, end)
        last = leave[1] if leave else max(table[end], key=lambda p: table[end][p][0])
        return self.back(table, end, last)

    def extend(self, text: str, ends: list[str | None]) -> None:
        """``path`` of a whole unit, place by place: ``ends[k]`` is the piece that ends at place ``k``. From a border on only one can, whatever
        follows, so the first one found is it, and places that are filled in already stay."""
        ids, tails, none = self.ids, self.tails, {}
        for place in range(len(ends), len(text) + 1):
            if text[place - 1] not in ids:
                ends.append(text[place - 1])
                continue
            found = None
            for begin in range(place - 1, -1, -1):
                piece = text[begin:place]
                whole = tails.get(piece)
                if whole is None:
                    break
                if whole and (before := ends[begin]) is not None:
                    follows = self.pairs.get(before, none).get(piece)
                    if follows is None:
                        follows = self.may_follow(before, piece) if before in ids else self.spine(piece) is not None
                    if follows:
                        found = piece
                        break
            ends.append(found)

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for piece in pieces:
            known = self.ids.get(piece)
            out.extend([known] if known is not None else [self.byte_ids[b] for b in _plain(piece).encode()])
        return out

    def learn(self, units: Iterable[str]) -> None:
        """Encode units that are not kept."""
        text, ends = "", [""]
        for unit in sorted(set(units)):
            before, text = text, _spell(unit)
            shared, most = 0, min(len(before), len(text))
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del ends[shared + 1 :]
            self.extend(text, ends)
            pieces, place = [], len(text)
            while place:
                pieces.append(ends[place])
                place -= len(ends[place])
            ids = self.numbers(pieces[::-1])
            self.units[unit] = len(self.widths)
            self.flat.extend(ids)
            self.starts.append(len(self.flat))
            self.widths.append(len(unit))
            self.exact.append(self.decode(ids) == unit)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, the n + 1 offsets of the texts, and whether each is what its ids decode to: all its units are, and
        they cover it. Texts begin and end at borders of units; blanks that stand before a text included."""
        found = [UNIT.findall(text) for text in texts]
        if len(self.units) >= KEPT_UNITS:
            self.forget()
        units = list(itertools.chain.from_iterable(found))
        ends = np.cumsum([0, *map(len, found)])
        unit = np.fromiter(map(self.units.get, units, itertools.repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(unit < 0)
        self.learn(units[k] for k in new)
        unit[new] = [self.units[units[k]] for k in new]
        starts = np.array(self.starts)
        sizes = np.diff(starts)[unit]
        at = np.cumsum(np.append(0, sizes))
        ids = np.array(self.flat)[np.repeat(starts[unit] - at[:-1], sizes) + np.arange(at[-1])]
        wrong = np.cumsum(np.append(0, np.frombuffer(bytes(self.exact), np.uint8)[unit] == 0))
        covered = np.cumsum(np.append(0, np.array(self.widths, np.int64)[unit]))
        whole = np.diff(covered[ends]) == np.fromiter(map(len, texts), np.int64, len(texts))
        return ids, at[ends], whole & (np.diff(wrong[ends]) == 0)

    def encode(self, text: str) -> list[int]:
        """A text, or a stretch of one that begins and ends at borders of units; blanks that stand before a text included."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the blank that stands before a text."""
        try:
            return "".join(map(self.shown.__getitem__, ids))
        except KeyError:  # characters of several bytes
            pass
        out, spelled = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                spelled.append(self.bytes_of[i])
                continue
            if spelled:
                out.append(spelled.decode("utf-8", "replace"))
                spelled = bytearray()
            out.append(self.spelled.get(i, "").replace(SPACE, " "))
        out.append(spelled.decode("utf-8", "replace"))
        return "".join(out)


def _spell(text: str) -> str:
    """Blanks as they are in pieces. The sign itself is swapped with the blank, which no piece has."""
    return text.replace(SPACE, "\0\0").replace(" ", SPACE).replace("\0\0", " ") if SPACE in text else text.replace(" ", SPACE)


def _plain(character: str) -> str:
    return SPACE if character == " " else character


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    normal = {model.id_to_piece(i): i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces(normal, {p: model.get_score(i) for p, i in normal.items()}, byte_ids)


def encode_texts(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``docs`` without ``text``, with ``chunk, n_chunks, ids, round_trip``: a row for each chunk of each row of ``docs``, one if the text is
    not longer than ``chunk`` code points.

    The ids of a text are those of its chunks in order, and equal the model's own. ``round_trip`` tells whether decoding gives the text back exactly. A null text has null
    ids, an empty one none. The character that stands for a blank in pieces is spelled in bytes. Repeated rows are encoded each; an empty table gives an empty
    result. Columns with these names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces = spark.sparkContext.broadcast(load_pieces(model))  # a few hundred kB
    docs, back = shield(docs, ("_e",))
    text, row = F.col("text"), free_name(docs, "_row")
    keep = [c for c in docs.columns if c.lower() not in ("text", "chunk", "n_chunks", "ids", "round_trip")]
    long_text = F.coalesce(F.length(text) > chunk, F.lit(False))
    whole = docs.where(~long_text).select(
        *keep, F.lit(0).alias("chunk"), F.lit(1).alias("n_chunks"), _whole(pieces)(text).alias("_e")
    )
    giant = docs.where(long_text).withColumn("text", F.concat(F.lit(" "), text))  # the blank that stands before a text
    giant = save(giant.withColumn(row, F.monotonically_increasing_id()), "giant")
    count = F.ceil(F.length(text) / chunk).cast("int")
    reach = pieces.value.longest
    start = F.col("chunk") * chunk
    cut = giant.select(row, text, count.alias("n_chunks"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk")).select(
        row, "chunk", "n_chunks",
        F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach))).alias("before"),
        F.substring(text, start + 1, F.lit(chunk)).alias("body"), F.substring(text, start + chunk + 1, F.lit(reach)).alias("after"),
    )
    cut = save(cut.repartition(row, "chunk"), "chunks")
    moves = cut.mapInPandas(_transfers(pieces), f"{row} long, chunk int, moves string")
    states = save(moves.groupBy(row).applyInPandas(_combine(row), f"{row} long, chunk int, enter string, leave string"), "states")
    parts = cut.join(states, [row, "chunk"]).select(row, "chunk", "n_chunks", _part(pieces)("before", "body", "after", "enter", "leave").alias("_e"))
    split = parts.join(giant.select(row, *keep), row).select(*keep, "chunk", "n_chunks", "_e")
    coded = whole.unionByName(split).select(*keep, "chunk", "n_chunks", F.col("_e.ids").alias("ids"), F.col("_e.round_trip").alias("round_trip"))
    return coded.withColumnsRenamed(back)


def _whole(pieces):
    @F.arrow_udf("ids array<int>, round_trip boolean")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum([0, *pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)])
            coded, at = [_coded(pieces.value, texts[:0])], 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
                coded.append(_coded(pieces.value, texts[at:to]))
                at = to
            yield pa.concat_arrays(coded)

    return encode.asNondeterministic()


def _coded(p: Pieces, texts: pa.Array) -> pa.StructArray:
    missing = pa.compute.is_null(texts)
    ids, ends, same = p.encode_all([f" {t}" if t else "" for t in texts.to_pylist()])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=missing)
    return pa.StructArray.from_arrays([lists, pa.array(same, mask=missing.to_numpy(zero_copy_only=False))], ["ids", "round_trip"])


def _plain_text(character: str) -> str:
    """A character of a spelled text as it was."""
    return SPACE if character == " " else " " if character == SPACE else character


def border(before: str, after: str) -> bool:
    """Whether a unit begins between two characters."""
    return before in BARRIER or after in BARRIER or after == " " != before


def _heads(before: str, body: str, after: str) -> tuple[str, int, int, int, int]:
    """The spelled text of a chunk with its surroundings, where the chunk begins and ends in it, and the first and last border of
    units inside (past the end if there is none)."""
    text = before + body + after
    at, to = len(before), len(before) + len(body)
    inside = (k for k in range(at + 1, to + 1) if k < len(text) and border(text[k - 1], text[k]))
    first = next(inside, to + 1)
    last = first
    if first <= to:
        last = next(k for k in range(to, at, -1) if k < len(text) and border(text[k - 1], text[k]))
    return _spell(text), at, to, first, last


def states_at(p: Pieces, text: str, cut: int) -> list[tuple[int, str]]:
    """All states a cut can have: how far the piece that spans it or ends at it reaches, and the piece."""
    if cut < len(text) and border(_plain_text(text[cut - 1]), _plain_text(text[cut])):
        return [BORDER]
    out = [(0, text[cut - 1])] if text[cut - 1] not in p.ids else []
    for begin in range(max(0, cut - p.longest), cut):
        for end in range(cut, min(len(text), begin + p.longest) + 1):
            if text[begin:end] in p.ids:
                out.append((end - cut, text[begin:end]))
    return out


def transfer(p: Pieces, before: str, body: str, after: str) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """The transfer matrix of a chunk, sparse: the states after it that follow from each state before it; others weigh minus
    infinity. The first chunk has one state before it, the last one only such after it as end with the text."""
    text, at, to, first, last = _heads(before, body, after)
    entries = states_at(p, text, at) if before else [BORDER]

    def leaving(table: dict) -> list[tuple[int, str]]:
        return [(k - to, piece) for k, held in table.items() if k >= to and (after or k == to) for piece in held]

    if first > to:
        return [(e, x) for e in entries for x in leaving(p.forward(text, {(at + e[0], e[1]): 0}, to))]
    leave = [BORDER] if last == to else leaving(p.forward(text, {(last, ""): 0}, to))
    arrive = [e for e in entries if first in p.forward(text, {(at + e[0], e[1]): 0}, first)]
    return list(itertools.product(arrive, leave))


def combine(a: set[tuple], b: set[tuple]) -> set[tuple]:
    """The product of two transfer matrices whose weights are 0 and minus infinity; associative."""
    by = {}
    for x, y in b:
        by.setdefault(x, []).append(y)
    return {(x, z) for x, y in a for z in by.get(y, ())}


def _transfers(pieces):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            moves = [repr(transfer(pieces.value, *x)) for x in zip(batch["before"], batch["body"], batch["after"], strict=True)]
            yield pd.DataFrame({batch.columns[0]: batch.iloc[:, 0], "chunk": batch["chunk"], "moves": moves})

    return run


def boundary_states(matrices: list[set[tuple]]) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """The state before and after each chunk: what both the products from the left and those from the right allow."""
    left = [{y for _, y in m} for m in itertools.accumulate(matrices, combine)]
    right = [{x for x, _ in m} for m in itertools.accumulate(matrices[::-1], lambda a, b: combine(b, a))][::-1]
    cuts = [BORDER, *(min(a & b) for a, b in zip(left[:-1], right[1:], strict=True)), min(left[-1])]
    return list(itertools.pairwise(cuts))


def _combine(row: str):
    import ast

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        found = boundary_states([set(ast.literal_eval(m)) for m in group["moves"]])
        return pd.DataFrame(
            {row: group[row], "chunk": group["chunk"], "enter": [repr(a) for a, _ in found], "leave": [repr(b) for _, b in found]}
        )

    return run


def chunk_ids(p: Pieces, before: str, body: str, after: str, enter: tuple[int, str], leave: tuple[int, str]) -> tuple[list[int], bool]:
    """The ids of the pieces that begin in the chunk, and whether they decode to its characters."""
    text, at, to, first, last = _heads(before, body, after)
    plain = before + body + after
    begin, end = at + enter[0], to + leave[0]
    if first > to:
        ids = p.numbers(p.path(text, (begin, enter[1]), (end, leave[1])))
    else:
        table = p.forward(text, {(begin, enter[1]): 0}, first)
        head = p.back(table, first, max(table[first], key=lambda x: table[first][x][0]))
        ids = p.numbers(head) + p.encode(plain[first:last])
        if last < end:
            ids += p.numbers(p.path(text, (last, ""), (end, leave[1])))
    return ids, p.decode(ids) == plain[begin:end]


def _part(pieces):
    import ast

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for before, body, after, enter, leave in batches:
            out = []
            for b, t, a, e, x in zip(before, body, after, enter, leave, strict=True):
                e, x = ast.literal_eval(e), ast.literal_eval(x)
                out.append(chunk_ids(pieces.value, b, t, a, e, x))
            yield pd.DataFrame(out, columns=["ids", "round_trip"])

    return run.asNondeterministic()


def decode_ids(chunks: DataFrame, model: str = MODEL) -> DataFrame:
    """``chunks`` with ``text`` from ``ids``, replacing a column of this name. The blank that stands before a text is taken off ``chunk`` 0. Null ids give a
    null text, unknown ids nothing. A document's text is that of its chunks in order."""
    spark = chunks.sparkSession
    ship_package(spark)
    pieces = spark.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, chunk in batches:
            yield pd.Series([None if i is None else pieces.value.decode(list(i))[1 if c == 0 else 0 :] for i, c in zip(ids, chunk, strict=True)], dtype=object)

    return chunks.withColumn("text", run("ids", "chunk"))
