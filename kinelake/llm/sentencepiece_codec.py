"""SentencePiece models on the tokenizers library: encode, decode, verify.

The model file's protobuf is parsed here; from it come the normaliser (character
map, dummy prefix, white-space rules), the metaspace marker, the pieces with their
scores - unigram, or merges in score order for a BPE model - and the byte
fallback. Batches are encoded by the library's own threads. Parity with the
sentencepiece library is verified on the normalised form of every text and on every
distinct chunk that a task meets: pieces never run across the start of a marker
run, so texts agree where these do.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from kinelake.llm.arrow import map_column

#: Place of the public model files; the driver reads the file and broadcasts its bytes.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"

#: Fixed values of the model format: piece types, model types, field numbers.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK = 3, 35
CHARS_MAP, DUMMY_PREFIX, SQUEEZE, ESCAPE = 2, 3, 4, 5

#: Chunks in the younger half of a process's memory, the older half holds as many, and
#: characters of a chunk that is remembered: some 50 MB together.
REMEMBERED, LONG = 150_000, 48
#: Chunks handed to the libraries at a time: each one's encoding holds far more than its ids.
LEARNED = 4096
#: Of those, chunks put together to one text for the libraries.
TOGETHER = 512


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; 4- and 8-byte values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire in (1, 2, 5):
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} isn't used in model files")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    chars_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == PIECES:
            parts = dict(_fields(value))
            score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
            model.pieces.append((parts.get(1, b"").decode("utf-8"), score, parts.get(3, NORMAL)))
        elif number == TRAINER:
            parts = dict(_fields(value))
            model.kind, model.byte_fallback = parts.get(MODEL_TYPE, UNIGRAM), bool(parts.get(BYTE_FALLBACK, 0))
        elif number == NORMALIZER:
            parts = dict(_fields(value))
            model.chars_map = parts.get(CHARS_MAP, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(parts.get(n, 1)) for n in (DUMMY_PREFIX, SQUEEZE, ESCAPE))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a normal piece into two pieces, best score first."""
    rank = {piece: (-score, i) for i, (piece, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = [(rank[piece], cut, piece) for piece in rank for cut in range(1, len(piece)) if piece[:cut] in rank and piece[cut:] in rank]
    return [(piece[:cut], piece[cut:]) for _, cut, piece in sorted(found)]


def _alone(pieces: list[tuple[str, float, int]]) -> bool:
    """No piece has a marker after another character, so none crosses the cut before a marker run."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in pieces)


def build_tokenizer(model: Model) -> Tokenizer:
    """Encoder of texts as they come: normaliser, marker cut, pieces.

    A unigram lattice would match any piece, so those that text can't make (control,
    unknown, unused and byte pieces) stand under names with a space, which the
    normaliser leaves in no text; ``Codec`` puts in the bytes of unknown characters.
    """
    if model.kind == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=_merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p if kind in (NORMAL, USER_DEFINED) else f" {i}", s) for i, (p, s, kind) in enumerate(model.pieces)], unk_id=model.unknown, byte_fallback=False)
    else:
        raise ValueError("only unigram and BPE models are rebuilt")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.chars_map)] if model.chars_map else []
    if model.squeeze:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if _alone(model.pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), behavior="isolated")
    return tokenizer


def build_decoder(model: Model) -> Tokenizer:
    """Decoder of ids under the pieces' own names; control pieces have no text."""
    names = ["" if kind == CONTROL else p for p, _, kind in model.pieces]
    own = {name or f" {i}": i for i, name in enumerate(names)}
    decoder = Tokenizer(models.WordLevel(vocab=own, unk_token=model.pieces[model.unknown][0]))
    silent = [decoders.Replace(Regex("^ [0-9]+$"), "")] if "" in names else []
    decoder.decoder = decoders.Sequence([*silent, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return decoder


class Codec:
    """Encoder, decoder and parity test of one model file's bytes.

    Ids, parity and restoration of each distinct chunk are learned once and looked
    up for whole texts: a text's ids are its chunks' ids put together, and it decodes
    to its chunks' texts put together. Chunks of over LONG characters aren't remembered.
    """

    def __init__(self, data: bytes, remembered: int = REMEMBERED) -> None:
        import sentencepiece

        self.remembered = remembered
        self.model = parse_model(data)
        # Chunks come to the tokenizer normalised.
        self.tokenizer = build_tokenizer(self.model)
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.decoder = build_decoder(self.model)
        self.chars = normalizers.Precompiled(self.model.chars_map) if self.model.chars_map else None
        # Line ends, which no piece holds, are cut off too: fewer chunks differ then.
        lines = "" if any("\n" in p for p, _, _ in self.model.pieces) else "\n"
        self.cut = re.compile(f"{MARK}+[^{MARK}{lines}]*|[^{MARK}{lines}]+" + (f"|{lines}+" if lines else "")) if self.tokenizer.pre_tokenizer is not None else re.compile(".+", re.S)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.anchor = len(self.reference.encode("\n"))
        names = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.bytes = [names[f"<0x{b:02X}>"] for b in range(256)] if self.model.kind == UNIGRAM and self.model.byte_fallback else []
        kinds = np.array([kind for _, _, kind in self.model.pieces])
        self.surface = [p for p, _, _ in self.model.pieces]
        self.is_byte = kinds == BYTE
        # Characters that a piece stands for; of a character's bytes, the first counts.
        self.lengths = np.array([len(p) if kind != BYTE else int(not 0x80 <= int(p[1:-1], 16) < 0xC0) for p, _, kind in self.model.pieces])
        self.door, self.passed = bytearray(1 << 21), 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Chunks on which the libraries differ, and those that decoding doesn't restore.
        self.differ: set[str] = set()
        self.lost: set[str] = set()

    def normalise(self, text: str) -> str:
        if self.chars:
            text = self.chars.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _ours(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks one by one; unknown characters become bytes where the model has them."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        unknown = self.model.unknown
        for i in [i for i, ids in enumerate(found) if unknown in ids] if self.bytes else []:
            own = self.tokenizer.encode(chunks[i], add_special_tokens=False)
            found[i] = [b for n, (start, end) in zip(own.ids, own.offsets, strict=True) for b in ([n] if n != unknown else [self.bytes[x] for x in chunks[i][start:end].encode()])]
        return found

    def _theirs(self, chunks: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of each chunk, as it stands inside a text."""
        # A lone marker would be an empty text; a chunk without marker follows a line end.
        first = int(self.model.dummy_prefix)
        starts = [not first or c[0] == MARK for c in chunks]
        found = self.reference.encode([(c[first:] if marked else "\n" + c).replace(MARK, " ") for c, marked in zip(chunks, starts, strict=True)], num_threads=1)
        return [[self.reference.piece_to_id(MARK)] if c == MARK and first else ids if marked else ids[self.anchor :] for c, ids, marked in zip(chunks, found, starts, strict=True)]

    def _one_by_one(self, chunks: list[str], verify: bool) -> list[bytes]:
        made = self._ours(chunks)
        if verify:
            self.differ |= {c for c, own, other in zip(chunks, made, self._theirs(chunks), strict=True) if own != other}
            self.lost |= {c for c, own in zip(chunks, self.decoder.decode_batch(made, skip_special_tokens=False), strict=True) if own != self._plain(c)}
        return [array("i", ids).tobytes() for ids in made]

    def _together(self, chunks: list[str], verify: bool) -> list[bytes] | None:
        """The same for chunks that begin with one marker, put together to a few texts;
        None if an unknown character hides where chunks end, or the libraries differ."""
        texts = ["".join(chunks[at : at + TOGETHER]) for at in range(0, len(chunks), TOGETHER)]
        made = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(made)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c) for c in chunks]), side="right")
        if ends[-1] != len(ids) or self.lengths[ids].sum() != sum(map(len, texts)) or (self.model.unknown == ids).any():
            return None
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        parts = [raw[start:stop] for start, stop in zip([0, *stops], stops, strict=False)]
        if verify:
            theirs = self.reference.encode([text.replace(MARK, " ")[1:] for text in texts], num_threads=1)
            if not np.array_equal(ids, np.concatenate([np.array(x, dtype=np.int32) for x in theirs])):
                return None
            # Pieces that spell a chunk decode to it; bytes go through the decoder.
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(self.is_byte[ids]), side="right")).tolist()
            plain = np.ones(len(chunks), dtype=bool)
            plain[odd] = False
            spelling = ids[np.repeat(plain, np.diff(ends, prepend=0))] if odd else ids
            if "".join(map(self.surface.__getitem__, spelling.tolist())) != "".join(c for c, keep in zip(chunks, plain.tolist(), strict=True) if keep):
                return None
            for i, text in zip(odd, self.decode([np.frombuffer(parts[i], dtype=np.int32).tolist() for i in odd]), strict=True):
                if text != self._plain(chunks[i]):
                    self.lost.add(chunks[i])
        return parts

    def _learn(self, chunks: list[str], verify: bool) -> dict[str, bytes]:
        """Ids of the chunks; those that differ or aren't restored are marked.

        Chunks with one marker in front are encoded and verified together, one by
        one only where that fails.
        """
        learned: dict[str, bytes] = {}
        joined, single = [], []
        for c in chunks:
            (joined if self.model.dummy_prefix and c[0] == MARK and c[1:2] not in ("", MARK) else single).append(c)
        for at in range(0, len(joined), LEARNED):
            part = joined[at : at + LEARNED]
            learned.update(zip(part, self._together(part, verify) or self._one_by_one(part, verify), strict=True))
        for at in range(0, len(single), LEARNED):
            part = single[at : at + LEARNED]
            learned.update(zip(part, self._one_by_one(part, verify), strict=True))
        return learned

    def _plain(self, normalised: str) -> str:
        """Normalised text without markers and the dummy prefix."""
        plain = normalised.replace(MARK, " ")
        return plain[1:] if self.model.dummy_prefix and plain[:1] == " " else plain

    def _remember(self, chunks: set[str], verify: bool) -> list[str]:
        """See that young holds all the chunks; those to be forgotten after their use."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
            self.differ &= self.old.keys()
            self.lost &= self.old.keys()
        new = chunks - self.young.keys()
        again = new & self.old.keys()
        if again:
            self.young.update((c, self.old[c]) for c in again)
            new -= again
        if not new:
            return []
        self.young.update(self._learn(list(new), verify))
        # Most chunks never return: only those met a second time stay.
        door, mask, passing = self.door, len(self.door) - 1, []
        for c in new:
            place = hash(c) & mask
            if not door[place] or len(c) > LONG:
                door[place] = 1
                passing.append(c)
        self.passed += len(passing)
        if 2 * self.passed > len(door):
            self.door, self.passed = bytearray(len(door)), 0
        return passing

    def encode(self, texts: list[str], verify: bool = False) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids of each text; whether the sentencepiece library agrees on its normalised form and on
        all its chunks; whether decoding gives the text again."""
        whole = [self.normalise(text) for text in texts]
        chunks = [self.cut.findall(text) for text in whole]
        passing = self._remember(set().union(*chunks), verify)
        get = self.young.__getitem__
        ids = [np.frombuffer(b"".join(map(get, own)), dtype=np.int32) for own in chunks]
        for c in passing:
            del self.young[c]
        if not verify:
            return ids, [], []
        differ, lost = self.differ, self.lost
        theirs = self.reference.normalize(texts)
        same = [a == b and (not differ or differ.isdisjoint(own)) for a, b, own in zip(whole, theirs, chunks, strict=True)]
        back = [self._plain(a) == text and (not lost or lost.isdisjoint(own)) for a, text, own in zip(whole, texts, chunks, strict=True)]
        differ.difference_update(passing)
        lost.difference_update(passing)
        return ids, same, back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode_batch(ids, skip_special_tokens=False)


class Carried:
    """A model's bytes, which a broadcast carries to task processes: each makes one codec of it, which goes when the broadcast is no longer used."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.data, self.remembered = Path(path).read_bytes(), remembered
        self.made: Codec | None = None

    def __reduce__(self):
        return _carry, (self.data, self.remembered)

    def codec(self) -> Codec:
        self.made = self.made or Codec(self.data, self.remembered)
        return self.made


def _carry(data: bytes, remembered: int) -> Carried:
    made = Carried.__new__(Carried)
    made.data, made.remembered, made.made = data, remembered, None
    return made


def encode(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", model: str = MODEL, verify: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """keep columns (all but the text, if not given), then ids array<int>, n_tokens long and parity boolean.

    Null text counts as empty and has no tokens; empty text has none either. Texts
    are encoded whole, however long. Special tokens' strings in a text are ordinary
    text. parity is null if verify is off. Rows are independent, so repeated rows
    give equal results; null ids pass. Columns of docs that are already called ids,
    n_tokens or parity are replaced. An empty table gives no rows. remembered: chunks that a
    process remembers (see REMEMBERED); results don't depend on it.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    names = [c for c in keep if c not in ("ids", "n_tokens", "parity")]
    shared = docs.sparkSession.sparkContext.broadcast(Carried(model, remembered))

    def run(values: list) -> list:
        own = shared.value.codec()
        texts = [value or "" for value in values]
        ids, same, _ = own.encode(texts, verify)
        return [ids, [len(x) for x in ids], same if verify else [None] * len(texts)]

    return map_column(docs, names, text_col, run, {"ids": "array<int>", "n_tokens": "long", "parity": "boolean"})


def decode(encoded: DataFrame, keep: list[str], ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """keep columns, then the text of the ids; null or no ids give empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Carried(model))

    def run(values: list) -> list:
        return [shared.value.codec().decode([list(v) if v is not None else [] for v in values])]

    return map_column(encoded, keep, ids_col, run, {text_col: "string"})


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, parity, restored: whether decoding the ids gives the text again.

    Texts that the model's normaliser changes can't be restored to the letter, nor
    the marker character itself, which decodes to a space in either library. Nulls,
    repeated rows and empty tables are as in ``encode``; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Carried(model))

    def run(values: list) -> list:
        ids, same, restored = shared.value.codec().encode([value or "" for value in values], verify=True)
        return [ids, [len(x) for x in ids], same, restored]

    slim = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_column(slim, ["doc_id"], "text", run, {"ids": "array<int>", "n_tokens": "long", "parity": "boolean", "restored": "boolean"})


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
