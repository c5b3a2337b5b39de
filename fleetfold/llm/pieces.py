"""SentencePiece encoding and decoding with a table of prefixes, for models of the merge type.

Merging pairs by score gives every prefix of a text exactly one last piece. An automaton over all pieces
lists those that end at a place; the one that may follow the last piece of the prefix before it is the
last piece here. Two pieces may follow each other if merging their joined characters gives them back.
From the last place the ids are read backwards, piece by piece.

Characters that stand side by side in no piece are never merged, so texts are cut there and equal parts
are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetfold.llm.common import whole_text

SPACE = "▁"  # fixed value: stands for a blank within pieces
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what an unknown id decodes to
# bounds of the memory a task uses: remembered parts of texts and pairs, ids of one batch
PARTS_KEPT, PART_LENGTH, PAIRS_KEPT, IDS_AT_ONCE = 400_000, 40, 400_000, 1_000_000
NEVER = float("-inf")


def merged(symbols: list[str], score: dict[str, float]) -> tuple[list[str], list[tuple[str, str]]]:
    """What merging the best pair first, the leftmost among equals, leaves of ``symbols``, and the merges."""
    symbols, steps = list(symbols), []
    while True:
        pairs = [(score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score]
        if not pairs:
            return symbols, steps
        i = -max(pairs)[1]
        steps.append((symbols[i], symbols[i + 1]))
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@dataclass
class PieceModel:
    """Tables of a model, made once on the driver and sent to the tasks; their size is the vocabulary's."""

    pieces: list[str]
    score: dict[str, float]  # of the pieces that merging may build
    number: dict[str, int]  # id of the pieces that can be left over, characters included
    surfaces: list[bytes]  # what each id decodes to
    bytes_at: int  # id of byte 0
    marked: set[int]  # ids whose first character is the stand-in for a blank
    silent: set[int]  # ids that decode to nothing
    touching: set[str]  # two characters that stand side by side in a piece
    # per piece: symbols at its left and right end with the scores at which they appear and vanish
    left_ends: dict[str, list[tuple[str, float, float]]] = field(default_factory=dict)
    right_ends: dict[str, list[tuple[str, float, float]]] = field(default_factory=dict)


def _ends(piece: str, steps: list[tuple[str, str]], score: dict[str, float], side: int) -> list[tuple[str, float, float]]:
    """Symbols at one end of ``piece``, from the whole inwards."""
    # equal symbols inside one piece are merged in the same way, as their surroundings never reach into them
    parts, found, now, gone = {a + b: (a, b) for a, b in steps}, [], piece, NEVER
    while True:
        made = score[now] if len(now) > 1 else float("inf")
        found.append((now, made, gone))
        if len(now) == 1:
            return found
        now, gone = parts[now][side], score[now]


def read_model(path: str) -> PieceModel:
    """The model file at ``path``, read on the driver.

    Models of another type, with a normaliser of their own or with user-defined pieces are refused.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        raw = file.read()
    spec = proto.ModelProto()
    spec.ParseFromString(raw)
    normal = spec.normalizer_spec
    if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
        raise ValueError("only merge-type models with byte fallback are supported")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
        raise ValueError("only models without normalisation and with a leading blank are supported")
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces):
        raise ValueError("user-defined pieces are not supported")
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    ordinary = [i for i in range(len(pieces)) if spec.pieces[i].type == proto.ModelProto.SentencePiece.NORMAL]
    score = {pieces[i]: library.get_score(i) for i in ordinary}
    touching = {a + b for p in score for a, b in zip(p, p[1:])}
    surfaces = []
    for i, piece in enumerate(pieces):
        shown = UNKNOWN_SURFACE if library.is_unknown(i) else "" if library.is_control(i) else piece.replace(SPACE, " ")
        surfaces.append(bytes([int(piece[3:5], 16)]) if library.is_byte(i) else shown.encode())
    marked = {i for i in ordinary if pieces[i].startswith(SPACE)}
    silent = {i for i in range(len(pieces)) if library.is_control(i)}
    model = PieceModel(pieces, score, {}, surfaces, library.piece_to_id("<0x00>"), marked, silent, touching)
    for i in ordinary:
        left, steps = merged(list(pieces[i]), score)
        if left != [pieces[i]]:
            continue  # merging never ends in this piece
        model.number[pieces[i]] = i
        scores = [score[a + b] for a, b in steps]
        if all(a >= b for a, b in zip(scores, scores[1:])):
            model.left_ends[pieces[i]] = _ends(pieces[i], steps, score, 0)
            model.right_ends[pieces[i]] = _ends(pieces[i], steps, score, 1)
    return model


def _utf8(data: bytes) -> str:
    """``data`` as text, U+FFFD for each byte that is no part of a character."""
    texts = []
    while True:
        try:
            return "".join([*texts, data.decode()])
        except UnicodeDecodeError as error:
            texts += [data[: error.start].decode(), "\ufffd"]
            data = data[error.start + 1 :]


class PieceCoder:
    """Encodes and decodes texts with the tables of a model; one per task."""

    def __init__(self, model: PieceModel):
        self.model, self.marked, self.silent = model, model.marked, model.silent
        self.automaton = ahocorasick.Automaton()
        for piece, number in model.number.items():
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in model.pieces]
        self.follow: dict[int, bool] = {}
        self.parts: dict[str, list[int]] = {}
        # no piece goes on with a blank behind another character: texts are first cut before such blanks
        whole = any(a != SPACE and b == SPACE for a, b in model.touching)
        # and around ASCII characters that are no piece
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in model.number) or SPACE
        self.words = re.compile(r"(?s).+" if whole else f"{SPACE}*[^{SPACE}{alone}]+|[{alone}]|{SPACE}+")

    def may_follow(self, left: int, right: int) -> bool:
        """Does merging the characters of both pieces give just these two pieces?"""
        a, b = self.model.pieces[left], self.model.pieces[right]
        ends, starts = self.model.right_ends.get(a), self.model.left_ends.get(b)
        if ends is None or starts is None:
            return merged(list(a + b), self.model.score)[0] == [a, b]
        score = self.model.score
        for x, x_made, x_gone in ends:
            for y, y_made, y_gone in starts:
                # a merge across the border needs both at once and must come before either is merged otherwise;
                # of equal scores the left merge comes first
                if x_made >= y_gone and y_made > x_gone:
                    across = score.get(x + y)
                    if across is not None and across > x_gone and across >= y_gone:
                        return False
        return True

    def _known_part(self, part: str) -> list[int] | None:
        """Ids of ``part``; None if it holds a character that is no piece."""
        sizes, follow = self.sizes, self.follow
        last = [-1] * len(part)
        for end, number in self.automaton.iter(part):
            if last[end] < 0:
                start = end - sizes[number]
                if start >= 0:
                    before = last[start]
                    if before < 0:
                        return None
                    key = before << 20 | number
                    if key in follow:
                        good = follow[key]
                    else:
                        if len(follow) >= PAIRS_KEPT:
                            follow.clear()
                        good = follow[key] = self.may_follow(before, number)
                    if not good:
                        continue
                last[end] = number
        ids, at = [], len(part) - 1
        while at >= 0:
            number = last[at]
            if number < 0:
                return None
            ids.append(number)
            at -= sizes[number]
        ids.reverse()
        return ids

    def _part(self, part: str) -> list[int]:
        ids = self._known_part(part)
        if ids is not None:
            return ids
        ids, number = [], self.model.number
        for known, some in groupby(part, number.__contains__):
            some = "".join(some)
            ids += self._known_part(some) if known else [self.model.bytes_at + b for b in some.encode()]
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids, parts = [], self.parts
        for word in self.words.findall(SPACE + text.replace(" ", SPACE)):
            known = parts.get(word)
            if known is None:
                known = self._part(word)
                if len(word) <= PART_LENGTH:
                    if len(parts) >= PARTS_KEPT:
                        parts.clear()
                    parts[word] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text; each byte that is no part of valid UTF-8 becomes U+FFFD."""
        runs = [ids]
        if not self.silent.isdisjoint(ids):
            runs = [list(run) for quiet, run in groupby(ids, self.silent.__contains__) if not quiet]
        if not runs or not runs[0]:
            return ""
        # the blank in front of the first piece was put there by the encoder
        skip = int(runs[0][0] in self.marked)
        texts = []
        for run in runs:
            texts.append(_utf8(b"".join(map(self.model.surfaces.__getitem__, run))[skip:]))
            skip = 0
        return "".join(texts)


def encode_texts(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the array of the ids of the whole text, and on request what they decode to.

    Null and empty texts have no ids. Repeated rows stay, other columns pass through untouched; columns named
    like the new ones are replaced. An empty table gives an empty result. Nothing is shuffled. Memory of a
    task is bounded by its longest text and the constants above; very long texts take time in proportion to
    their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [ids] if decoded is None else [ids, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            texts, first, flat, ends, again = batch.column(batch.num_columns - 1), 0, [], [0], []
            for i in range(batch.num_rows):
                found = coder.encode(texts[i].as_py())
                flat.append(np.array(found, dtype=np.int32))
                ends.append(ends[-1] + len(found))
                if decoded is not None:
                    again.append(coder.decode(found))
                if ends[-1] >= IDS_AT_ONCE or i == batch.num_rows - 1:
                    added = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))]
                    if decoded is not None:
                        added.append(pa.array(again, pa.string()))
                    rows = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *added], [*batch.schema.names[:-1], *new])
                    first, flat, ends, again = i + 1, [], [0], []

    kept = docs.drop(*new)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.StringType())][: len(new)]
    whole = whole_text(text).alias("__whole")
    return docs.select(*(F.col(f"`{c}`") for c in kept.columns), whole).mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def decode_ids(df: DataFrame, model: PieceModel, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``, the text of the array of ids; null counts as an empty array."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            lists, first, texts, size = batch.column(batch.num_columns - 1), 0, [], 0
            for i in range(batch.num_rows):
                texts.append(coder.decode(lists[i].values.to_numpy().tolist()))
                size += len(texts[-1])
                if size >= 4 * IDS_AT_ONCE or i == batch.num_rows - 1:
                    rows = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], decoded])
                    first, texts, size = i + 1, [], 0

    kept = df.drop(decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])
    filled = F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>"))
    return kept.select("*", filled.alias("__ids")).mapInArrow(run, schema)
