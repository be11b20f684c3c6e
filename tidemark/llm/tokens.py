"""Token ids by a public tokenizer, with the ids of every distinct word kept for reuse."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

# The letters, spaces and signs for which splits() cuts as the tokenizer's own pattern does.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(f"[\t\n\r\x20-\x7e{LETTERS}×÷¡§©«®°·»¿‐-‧‰-⁞₠-₿]*")
# A space between two other characters begins a piece, whatever is around.
CUT = re.compile("(?<=[^ \t\n\r]) (?=[^ \t\n\r])")

# Kinds of characters by their first byte; END ends each text.
END, LETTER, DIGIT, OTHER, SPACE, BREAK = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0, *b" \t\n\r"]] = END, SPACE, BREAK, BREAK, BREAK
KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
KIND[48:58] = DIGIT


def _begins(before: int, here: int, after: int) -> bool:
    """Does a piece begin at a character between these two? Runs of one kind are pieces. The last space before a run is part
    of it, and the last white space of several is a piece of its own otherwise."""
    if END in (before, here):
        return True
    if here >= SPACE:
        return before < SPACE or END < after < SPACE
    return before not in (here, SPACE)


BEGINS = np.array([_begins(a, b, c) for a in range(6) for b in range(6) for c in range(6)])

# A byte-level entry has one character for each of its bytes: those that print stand for themselves, the others follow from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGNS = np.arange(256, dtype="<u2")
SIGNS[np.setdiff1d(SIGNS, PRINTED)] = np.arange(256, 512 - len(PRINTED))

# Pieces and ids that are kept, and the characters that are cut into pieces at a time.
MAX_WORDS, MAX_IDS, CHARS = 250_000, 4_000_000, 1 << 20


def splits(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of plain texts, each of which ends with a zero byte, as does the whole.

    As the pattern `'(?:s|t|re|ve|m|ll|d)| ?letters| ?digits| ?others|white(?!other than white)|white` has them.
    """
    at = None if data.max() < 128 else np.flatnonzero((data & 0xC0) != 0x80)
    first = data if at is None else data[at]
    kind = np.zeros(len(first) + 2, np.uint8)
    kind[1:-1] = KIND[first]
    if at is not None:
        odd = np.flatnonzero(first == 0xC3)
        kind[1 + odd[np.isin(data[at[odd] + 1], (0x97, 0xB7))]] = OTHER  # × and ÷
    begins = BEGINS[kind[:-2] * 36 + kind[1:-1] * 6 + kind[2:]]
    # An apostrophe that begins a piece takes these endings with it and leaves the rest of the word.
    marks = np.flatnonzero(first == ord("'"))
    marks = marks[begins[marks]]
    one, two = first[marks + 1], first[np.minimum(marks + 2, len(first) - 1)]
    short = np.isin(one, [*b"stmd"])
    long = np.isin(one * np.uint16(256) + two, [c[0] * 256 + c[1] for c in (b"re", b"ve", b"ll")])
    begins[marks[short | long] + 1] = False
    begins[marks[short] + 2] = True
    begins[marks[long] + 3] = True
    begins = np.flatnonzero(begins)
    return begins if at is None else at[begins]


class Memory:
    """Pieces, numbered from 1, and the ids of each. Number 0 is the end of a text, which has none."""

    def __init__(self, code: str):
        self.number = {b"\0": 0}
        self.ids, self.ends = array(code), array("q", [0, 0])

    def add(self, pieces: list[bytes], ids: Iterable[int], n: np.ndarray) -> None:
        """ids: of all pieces, one after another; n: how many each has."""
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.ends.frombytes((len(self.ids) + np.cumsum(n, dtype=np.int64)).tobytes())
        self.ids.extend(ids)

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """-1 for what isn't there."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these pieces, one after another, and how many each has."""
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.dtype(f"<u{self.ids.itemsize}"))
        begin = ends[numbers]
        n = ends[numbers + 1] - begin
        to = np.cumsum(n)
        return ids[np.repeat(begin - to + n, n) + np.arange(to[-1] if len(to) else 0)], n


class Encoder:
    """ids(texts) gives each text's ids as little-endian bytes of `dtype`.

    A byte-level BPE encodes each piece of its split pattern by itself, so the tokenizer's model gets a piece once
    and its ids are reused. Texts with characters outside PLAIN, or with the text of a special token,
    go to the tokenizer whole. Of pieces about MAX_WORDS are kept; beyond them a new memory begins, which takes over from the last one what comes again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known, self.older = Memory(self.code), Memory(self.code)

    def _plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | list[bytes]] = []
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (k, _), ids in zip(held, self._some([t for _, t in held]), strict=True):
                out[k].append(ids)

        for k, text in enumerate(texts):
            if not self._plain(text):
                out.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes())
                continue
            out.append([])
            for part in _parts(text):
                held.append((k, part))
                size += len(part)
                if size >= CHARS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return [b"".join(x) if isinstance(x, list) else x for x in out]

    def _some(self, texts: list[str]) -> list[bytes]:
        data = np.frombuffer("\0".join([*texts, ""]).encode(), np.uint8)
        cuts = np.append(splits(data), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        ids, n = self.known.of(numbers)
        stops, got = (np.cumsum(n)[numbers == 0] * self.dtype.itemsize).tolist(), ids.tobytes()
        return [got[a:b] for a, b in zip([0, *stops], stops)]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Each piece's number in the memory, which learns those that are new."""
        if len(self.known.number) > MAX_WORDS or len(self.known.ids) > MAX_IDS:
            self.known, self.older = Memory(self.code), self.known
        numbers = self.known.numbers(pieces)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            missing = [pieces[k] for k in unknown.tolist()]
            self._learn(missing)
            numbers[unknown] = self.known.numbers(missing)
        return numbers

    def _learn(self, pieces: list[bytes]) -> None:
        before = self.older.numbers(pieces)
        self.known.add(list(compress(pieces, (before >= 0).tolist())), *self.older.of(before[before >= 0]))
        new = list(compress(pieces, (before < 0).tolist()))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            signs = SIGNS[np.frombuffer(b"\0".join(part), np.uint8)].tobytes().decode("utf-16-le").split(chr(SIGNS[0]))
            got = [[t.id for t in tokens] for tokens in map(self.model.tokenize, signs)]
            self.known.add(part, chain.from_iterable(got), np.fromiter(map(len, got), np.int64, len(got)))


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about CHARS characters, cut where a piece begins whatever is around."""
    at = 0
    while len(text) - at > CHARS and (cut := CUT.search(text, at + CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
