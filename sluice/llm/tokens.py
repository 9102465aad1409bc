"""Token ids of whole texts with a public word-level BPE vocabulary, a batch at a time.

The vocabulary lower-cases, drops white space and never merges across it, so a
text is the concatenation of its space-separated chunks. Chunks of a batch are
dictionary-encoded and, where they are a word with signs after it, parted into
these; each distinct piece is tokenised once, and a bounded cache keeps results
between batches of a worker. Chunks of plain Latin letters and
ASCII go through a byte-pair merger that takes any adjacent pair whose joined
bytes are in the vocabulary, lowest id first; ``unsafe_ids`` lists the tokens
for which that could differ from the listed merges, and a chunk with such a
token, or with any other character, is left to the reference tokenizer.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from sluice.llm import scan
from sluice.llm.gsaca import spread

WORD_END = "</w>"
#: A byte that UTF-8 never holds stands for the end of a word.
END = b"\xff"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: A chunk that is a word and the signs after it: one piece each.
WORD_AND_SIGNS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-/:-@\[-`{-~]*)$"
#: Stands for the ids of a piece that has an unsafe token.
UNSAFE = b"?"
CACHE_ENTRIES = 300_000
BATCH_BYTES = 4 << 20


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_bytes(token: str, byte_of: dict[str, int]) -> bytes:
    ends = token.endswith(WORD_END)
    return bytes(byte_of[c] for c in (token.removesuffix(WORD_END) if ends else token)) + (END if ends else b"")


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], list[list[str]]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = _byte_of()
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {_as_bytes(k, byte_of): v for k, v in spec["model"]["vocab"].items() if k not in special}
    return ranks, spec["model"]["merges"]


@lru_cache(maxsize=2)
def unsafe_ids(path: str) -> frozenset[int]:
    """Tokens whose own bytes the free merger joins by a pair that the vocabulary does not list."""
    ranks, merges = _vocabulary(path)
    byte_of = _byte_of()
    listed = {(_as_bytes(a, byte_of), _as_bytes(b, byte_of)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)}
    out = set()
    for token, number in ranks.items():
        parts = [bytes([b]) for b in token]
        if len(parts) > 1 and token.endswith(END):
            parts[-2:] = [parts[-2] + END]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60 or (parts[at], parts[at + 1]) not in listed:
                out.add(number)
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return frozenset(out)


class Encoder:
    """Token ids by ``path``; ``unsafe`` as ``unsafe_ids`` gives them."""

    def __init__(self, path: str, unsafe: frozenset[int] = frozenset()):
        ranks, _ = _vocabulary(path)
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.full = Tokenizer.from_file(path)
        self.unsafe = unsafe
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            ids = [i for piece in PIECES.findall(chunk.lower()) for i in self.merge(piece.encode() + END)]
            if not self.unsafe or self.unsafe.isdisjoint(ids):
                return np.array(ids, "<u4").tobytes()
        return np.array(self.full.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a lower-case word, or of signs; UNSAFE if the merger may not be used for it."""
        ids = self.merge(piece.encode() + END)
        return array("I", ids).tobytes() if self.unsafe.isdisjoint(ids) else UNSAFE

    def distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks laid end to end, and how many each has."""
        cache, pieces = self.cache, self.pieces
        if len(cache) + len(pieces) > CACHE_ENTRIES:
            cache.clear()
            pieces.clear()
            pieces[""] = b""
        parted = pc.extract_regex(chunks, WORD_AND_SIGNS)
        special = pc.or_kleene(pc.is_null(parted), pc.match_substring(chunks, "<|")).to_numpy(zero_copy_only=False)
        found, of = [b""], np.zeros((len(chunks), 2), np.int64)  # a chunk's two pieces
        for k, name in enumerate(("word", "signs")):
            coded = pc.fill_null(pc.utf8_lower(pc.struct_field(parted, name)), "").dictionary_encode()
            of[:, k] = coded.indices.to_numpy() + len(found)
            for p in coded.dictionary.to_pylist():
                ids = pieces.get(p)
                if ids is None:
                    ids = pieces[p] = self.piece(p)
                found.append(ids)
        size = np.array([len(x) for x in found], np.int64)
        other = np.flatnonzero(special | (size[of] % 4 > 0).any(axis=1))
        of[other] = 0
        of[other, 0] = np.arange(len(other)) + len(found)
        for c in chunks.take(pa.array(other)).to_pylist():
            ids = cache.get(c)
            if ids is None:
                ids = cache[c] = self.chunk(c)
            found.append(ids)
        found = [b"" if x is UNSAFE else x for x in found]
        length = np.array([len(x) for x in found], np.int64) // 4
        start = np.cumsum(length) - length
        at, _ = spread(start[of.ravel()], length[of.ravel()])
        return np.frombuffer(b"".join(found), "<u4")[at], length[of].sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and the n + 1 offsets; a null text has none."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        per_text = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        flat, length = self.distinct(coded.dictionary)
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        index = coded.indices.to_numpy()
        at, _ = spread(start[index], length[index])
        ends = np.concatenate([[0], np.cumsum(length[index])])[np.concatenate([[0], np.cumsum(per_text)])]
        return flat[at], ends


@lru_cache(maxsize=1)
def encoder(path: str, unsafe: frozenset[int]) -> Encoder:
    """One encoder, with its cache, per worker process."""
    return Encoder(path, unsafe)


def batches(column: pa.Array, size: int = BATCH_BYTES):
    """Ranges of whole texts of about ``size`` bytes."""
    yield from scan.chunks(scan.text_bytes(column)[1], size, most=1 << 30)
