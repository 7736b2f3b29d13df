"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

Encoding. Two neighbouring tokens are compatible if merging their joint bytes by rank gives these two again. An
encoding is the merge result of its bytes exactly if each of its tokens is one that merging its own bytes gives and all
neighbours are compatible, so the last token of every prefix is unique. The transducer reads bytes; its state is
the set of hypotheses that can still win (a node of the vocabulary's trie and the tokens not yet emitted), kept
canonical by emitting what all of them share. The longest token bounds the lookahead. States and transitions are
made when first needed. Text brings new pieces without end, so those not seen before read their bytes side by side:
a byte of all of them is one step, and the transitions it lacks are made together.

Decoding. Tokens may cut characters. `Utf8Machine` takes bytes as they come and gives back whole characters.

Defined results: null and empty texts have no tokens and decode to nothing; only the key column and the
outputs are returned, so clashing columns of the input do no harm; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.common import STEP_BYTES, lean, steps, within

#: States and remembered pieces are dropped beyond these numbers and made again, so that memory stays bounded.
MAX_STATES, MAX_PIECES = 100_000, 600_000
#: Pieces longer than this many characters are encoded without being remembered.
LONG_PIECE = 64
#: Pieces longer than this many bytes are read one at a time; of the others so many bytes are read side by side.
LONG_BYTES, BLOCK = 256, 1 << 18
#: Where a text may be cut before it is split into pieces: at a lone space between two characters that aren't space.
#: No piece has a space after another character, so the pieces of the parts are those of the text.
OTHER_SPACE = re.compile(r"[^\S \n]")
SAFE = re.compile(r"(?<=\S)(?= \S)")


#: No token: the low 20 bits of a hypothesis.
NONE = (1 << 20) - 1


class Vocabulary:
    """Ranks of byte strings, the trie of those that merging can make, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.size = {r: len(b) for b, r in ranks.items()}
        #: The trie: node << 8 | byte to node; for each node its token or -1, and whether it has children.
        self.go: dict[int, int] = {}
        self.ends, self.grows = [-1], [True]
        self._fits: dict[int, bool] = {}
        self._spines: dict[tuple[int, bool], list] = {}
        for b, r in ranks.items():
            if self.merge(b) != [b]:
                continue  # no sequence of merges ends in it; it only stands for a whole piece
            node = 0
            for c in b:
                at = node << 8 | c
                if at not in self.go:
                    self.go[at] = len(self.ends)
                    self.grows[node] = True
                    self.ends.append(-1)
                    self.grows.append(False)
                node = self.go[at]
            self.ends[node] = r
        self.ends_at, self.grows_at = np.array(self.ends, np.int64), np.array(self.grows)
        self.size_of = np.zeros(max(self.token) + 1, np.int64)
        self.size_of[list(self.size)] = list(self.size.values())

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """Merge by lowest rank, leftmost first, ranks under `below` alone: what defines an encoding."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joint = [self.ranks.get(a + b, below) for a, b in pairwise(parts)]
            if (low := min(joint)) >= below:
                break
            i = joint.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts of a token that stand at its right (or left) edge while it is merged, each with the rank of the merge that swallows it."""
        known = self._spines.get((token, right))
        if known is None:
            part, swallowed, known = self.token[token], float("inf"), []
            while True:
                known.append((part, swallowed))
                if len(part) == 1:
                    break
                swallowed = self.ranks[part]
                part = self.halves(part)[right]
            self._spines[token, right] = known
        return known

    def halves(self, part: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge is the last one inside `part`."""
        parts = self.merge(part, below=self.ranks[part])
        return parts[0], parts[-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` can follow `left` in an encoding: no merge across their border comes before both edges are swallowed."""
        known = self._fits.get(left << 24 | right)
        if known is None:
            if len(self._fits) > 4 * MAX_STATES:
                self._fits.clear()
            rank, known = self.ranks.get, True
            for a, until_a in self.spine(left, True):
                for b, until_b in self.spine(right, False):
                    m = rank(a + b)
                    if m is not None and m < until_a and m <= until_b:
                        known = False
            self._fits[left << 24 | right] = known
        return known

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fits` for pairs side by side; anything fits after NONE."""
        keys, which = np.unique(left << 24 | right, return_inverse=True)
        known = [self._fits.get(k) for k in keys.tolist()]
        for i, k in enumerate(known):
            if k is None:
                a, b = int(keys[i]) >> 24, int(keys[i]) & (1 << 24) - 1
                known[i] = a == NONE or self.fits(a, b)
        return np.array(known, bool)[which]


class Transducer:
    """Bytes in, tokens out. State 0 is the start; states and transitions come into being when first met.

    A state is the set of hypotheses (trie node of the bytes since a token border, last token before it). Each move tells
    the one token that ends there; what all hypotheses share behind them is emitted.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: No token is longer, so no border further back than this can still change.
        self.lookahead = max(map(len, vocabulary.ranks))
        self.reset()

    def reset(self) -> None:
        #: State number of the hypotheses, as the bytes of their 64-bit numbers, and the reverse.
        self.number: dict[bytes, int] = {}
        self.states: list[bytes] = []
        #: state << 8 | byte to state << 20 | token that ends there
        self.moves: dict[int, int] = {}
        self._state(array("q", [NONE]).tobytes())

    def _state(self, hypotheses: bytes) -> int:
        n = self.number.get(hypotheses)
        if n is None:
            n = self.number[hypotheses] = len(self.states)
            self.states.append(hypotheses)
        return n

    def _move(self, state: int, byte: int) -> int:
        """Every hypothesis (node << 20 | last token) reads the byte; the one that completes a compatible token starts a new one."""
        alive, ended, go, ends, grows = array("q"), NONE, self.v.go, self.v.ends, self.v.grows
        for h in memoryview(self.states[state]).cast("q"):
            node = go.get(h >> 20 << 8 | byte)
            if node is None:
                continue
            last = h & NONE
            if ended == NONE and (token := ends[node]) >= 0 and (last == NONE or self.v.fits(last, token)):
                ended = token
            if grows[node]:
                alive.append(node << 20 | last)
        alive.append(ended)  # at the root; each prefix has an encoding, so one token ends here
        move = self.moves[state << 8 | byte] = self._state(alive.tobytes()) << 20 | ended
        return move

    def _moves(self, at: np.ndarray) -> np.ndarray:
        """The moves of many states and bytes (state << 8 | byte) side by side. Those not met before are made together, as `_move` makes one."""
        to = np.fromiter(map(self.moves.get, at.tolist(), repeat(-1)), np.int64, len(at))
        unmet = np.flatnonzero(to < 0)
        if not len(unmet):
            return to
        fresh, which = np.unique(at[unmet], return_inverse=True)
        held = [self.states[k] for k in (fresh >> 8).tolist()]
        of = np.repeat(np.arange(len(fresh)), np.fromiter(map(len, held), np.int64, len(held)) >> 3)
        h = np.frombuffer(b"".join(held), np.int64)
        keys = h >> 20 << 8 | (fresh & 255)[of]
        node = np.fromiter(map(self.v.go.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        goes = node >= 0
        node, last, of = node[goes], h[goes] & NONE, of[goes]
        token = self.v.ends_at[node]
        ended = np.full(len(fresh), NONE)
        may = np.flatnonzero(token >= 0)
        may = may[self.v.fit(last[may], token[may])]
        first, i = np.unique(of[may], return_index=True)
        ended[first] = token[may[i]]
        grows = self.v.grows_at[node]
        count = np.bincount(of[grows], minlength=len(fresh))
        end = np.cumsum(count + 1)
        alive = np.empty(end[-1], np.int64)
        alive[end - 1] = ended
        alive[np.repeat(end - 1 - count, count) + within(count)] = (node << 20 | last)[grows]
        raw, end = alive.tobytes(), end * 8
        state = [self._state(raw[i:j]) for i, j in zip((end - 8 * (count + 1)).tolist(), end.tolist(), strict=True)]
        made = np.array(state, np.int64) << 20 | ended
        self.moves.update(zip(fresh.tolist(), made.tolist(), strict=True))
        to[unmet] = made[which]
        return to

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces end to end, and the number of each piece's. Pieces read their bytes side by side, BLOCK bytes of them at a time; a long one reads alone."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter(map(self.v.ranks.get, pieces, repeat(-1)), np.int64, len(pieces))
        alone = {int(i): self.encode(pieces[i]) for i in np.flatnonzero((whole < 0) & (size > LONG_BYTES))}
        counts = np.minimum(size, 1)
        for i, ids in alone.items():
            counts[i] = len(ids)
        many = np.flatnonzero((whole < 0) & (size > 0) & (size <= LONG_BYTES))
        many = many[np.argsort(-size[many], kind="stable")]
        paths = []
        for own in np.split(many, np.flatnonzero(np.diff(np.cumsum(size[many]) // BLOCK)) + 1) if len(many) else []:
            paths.append((own, *self._side_by_side([pieces[i] for i in own.tolist()], size[own])))
            counts[own] = paths[-1][2]
        end = np.cumsum(counts)
        out = np.empty(end[-1] if len(end) else 0, np.int64)
        out[end[whole >= 0] - 1] = whole[whole >= 0]
        for i, ids in alone.items():
            out[end[i] - len(ids) : end[i]] = ids
        for own, ids, n in paths:
            out[np.repeat(end[own] - n, n) + within(n)] = ids
        return out, counts

    def _side_by_side(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and their numbers for pieces in descending order of size: those that have a byte at a place come first."""
        if len(self.states) > MAX_STATES:
            self.reset()
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(size) - size
        state, ends = np.zeros(len(pieces), np.int64), np.empty(len(raw), np.int64)  # ends: the token that ends at each byte
        for d in range(int(size[0])):
            n = int(np.searchsorted(-size, -d))
            to = self._moves(state[:n] << 8 | raw[begin[:n] + d])
            state[:n] = to >> 20
            ends[begin[:n] + d] = to & NONE
        is_last = np.zeros(len(raw), bool)  # bytes at which the tokens of the encoding end
        at = begin + size - 1
        while len(at):
            is_last[at] = True
            back = at - self.v.size_of[ends[at]]
            at, begin = back[back >= begin], begin[back >= begin]
        return ends[is_last], np.add.reduceat(is_last, np.cumsum(size) - size, dtype=np.int64)

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece. A piece that is itself in the vocabulary is its own token."""
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self.reset()
        out: list[int] = []
        ends: list[int] = []  # the token that ends at each byte not yet emitted
        state, moves, move_on = 0, self.moves, self._move
        for c in piece:
            at = state << 8 | c
            to = moves.get(at)
            if to is None:
                to = move_on(state, c)
            state = to >> 20
            ends.append(to & NONE)
            if len(ends) > 4 * self.lookahead:
                ends = self._emit(ends, out)
        return out + self._back(ends, len(ends))[0]

    def _back(self, ends: list[int], at: int) -> tuple[list[int], list[int]]:
        """The tokens that lead to byte `at`, and their borders."""
        tokens, borders, size = [], [at], self.v.size
        while at:
            tokens.append(ends[at - 1])
            at -= size[tokens[-1]]
            borders.append(at)
        return tokens[::-1], borders[::-1]

    def _emit(self, ends: list[int], out: list[int]) -> list[int]:
        """Emit up to the last border that every border within the lookahead leads back to."""
        shared = set(self._back(ends, len(ends))[1])
        for i in range(len(ends) - self.lookahead, len(ends)):
            shared &= set(self._back(ends, i)[1])
        cut = max(shared)
        out += self._back(ends, cut)[0]
        return ends[cut:]


class Utf8Machine:
    """Decodes bytes as they come. Holds back a started character; malformed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.need, self.held, self.low, self.high = 0, bytearray(), 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.need = 0
                self.held.clear()
                self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.held.append(b)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = ("�" if self.need else ""), 0
        self.held.clear()
        self.low, self.high = 0x80, 0xBF
        return left


class Codec:
    """Encoder and decoder over one vocabulary file, with pieces remembered across texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(Vocabulary.load(path))
        self.find = regex.compile(pattern).findall
        tokens = self.transducer.v.token
        size = max(tokens) + 1
        self.lens = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.decimals = list(map(str, range(size)))
        self.whole = np.array([self._whole(tokens.get(i, b"")) for i in range(size)])
        self.forget()

    @staticmethod
    def _whole(b: bytes) -> bool:
        try:
            return bool(b.decode()) or True
        except UnicodeDecodeError:
            return False

    remember = MAX_PIECES

    def forget(self) -> None:
        """Start anew with what is remembered: pieces of the splitting pattern, and parts of texts between spaces.

        `known` has the number of each: of its ids in `ids`, and as decimals in `texts`.
        """
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts, self.starts, self.ids = array("q"), array("q"), array("q")

    def rest(self, most: int) -> None:
        """Between tasks: what has grown beyond `most` pieces or states, or four fits for each, is dropped, and made again when next needed."""
        t = self.transducer
        if len(self.texts) > most or len(self.ids) > 16 * most:
            self.forget()
        if len(t.states) > most:
            t.reset()
        if len(t.v._fits) > 4 * most:
            t.v._fits.clear()
            t.v._spines.clear()

    def learn(self, parts: list[str]) -> list[str]:
        """Number distinct parts that are not known. Their unknown pieces are encoded side by side; a part of several pieces is put together from them.

        Returns what is too long to be remembered.
        """
        pieces, n = self.split(parts)
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.known]
        ids, counts = self.transducer.encode_all([p.encode() for p in fresh])
        end = np.cumsum(counts)
        self.known.update(zip(fresh, range(len(self.texts), len(self.texts) + len(fresh)), strict=True))
        self.starts.frombytes((len(self.ids) + end - counts).tobytes())
        self.counts.frombytes(counts.tobytes())
        self.ids.frombytes(ids.tobytes())
        decimals = list(map(self.decimals.__getitem__, ids.tolist()))
        self.texts += [",".join(decimals[i:j]) for i, j in zip((end - counts).tolist(), end.tolist(), strict=True)]
        i = 0
        for part, k in zip(parts, n, strict=True):
            if part not in self.known:
                at = [self.known[p] for p in pieces[i : i + k]]
                self.known[part] = len(self.texts)
                self.texts.append(",".join([self.texts[a] for a in at]))
                self.starts.append(len(self.ids))
                for a in at:
                    self.ids.extend(self.ids[self.starts[a] : self.starts[a] + self.counts[a]])
                self.counts.append(len(self.ids) - self.starts[-1])
            i += k
        return [p for p in {*parts, *fresh} if len(p) > LONG_PIECE]

    def split(self, parts: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all parts end to end, and the number of each part's.

        Parts from a space to a character that isn't space are split as one text, which has safe spaces between them.
        """
        joint = [p[:1] == " " and not p[-1].isspace() for p in parts]
        pieces = self.find("".join([p for p, j in zip(parts, joint, strict=True) if j]))
        end = np.cumsum([0, *(len(p) for p, j in zip(parts, joint, strict=True) if j)])
        piece_end = np.cumsum([0, *map(len, pieces)])
        at = np.searchsorted(piece_end, end)
        if piece_end[-1] != end[-1] or (piece_end[at] != end).any():  # a pattern that leaves something out
            joint = [False] * len(parts)
        out, n, counts = [], [], iter(np.diff(at).tolist())
        i = 0
        for part, j in zip(parts, joint, strict=True):
            if j:
                k = next(counts)
                out += pieces[i : i + k]
                i += k
            else:
                own = self.find(part)
                out += own
                k = len(own)
            n.append(k)
        return out, n

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text before each of its safe spaces. Where no white space touches another, plain splitting finds the same."""
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
            return SAFE.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text its token ids, and the same as decimals joined by commas."""
        if len(self.texts) > self.remember or len(self.ids) > 16 * self.remember:
            self.forget()
        cuts = list(map(self.cut, texts))
        long = self.learn([p for p in dict.fromkeys(chain.from_iterable(cuts)) if p not in self.known])
        places = [list(map(self.known.__getitem__, c)) for c in cuts]
        for p in long:
            del self.known[p]
        counts, starts = np.array(self.counts, np.int64), np.array(self.starts, np.int64)
        ids = np.array(self.ids, np.int64)
        out = []
        for at in places:
            i = np.array(at, np.int64)
            c = counts[i]
            out.append((ids[np.repeat(starts[i], c) + within(c)], ",".join(map(self.texts.__getitem__, at))))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        c = self.lens[ids]
        return self.flat[np.repeat(self.token_at[ids], c) + within(c)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: runs of tokens that are whole characters at once, the others through the machine."""
        machine, out = Utf8Machine(), []
        odd = np.flatnonzero(~self.whole[ids])
        at = 0
        for cut in np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1) if len(odd) else []:
            i, j = int(cut[0]), int(cut[-1]) + 1
            out.append(self.decode_bytes(ids[at:i]).decode())
            out += [machine.feed(self.decode_bytes(ids[k : k + 1])) for k in range(i, j)]
            out.append(machine.end())
            at = j
        return "".join([*out, self.decode_bytes(ids[at:]).decode()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


TYPES = {"n_tokens": "long", "ids": "array<long>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), remember: int = MAX_PIECES, carry: int | None = None) -> DataFrame:
    """Encode every whole text, then decode the ids.

    outputs: of n_tokens, ids, decoded, and the digests ids_sha256 (of decimal ids joined by commas) and decoded_sha256
    (of the decoded text's bytes), which are taken where the ids and the decoded text are, so neither travels.
    path: a rank file that each executor can read. remember: pieces that a worker keeps encoded, about 300 bytes each. carry: of these, how many it
    takes along from task to task (see `Codec.rest`), where its executor has other work besides; it then reads half as much text at a time. None: all. Narrow: one pass, no shuffle.
    """
    if unknown := set(outputs) - set(TYPES):
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        c.remember = remember
        for batch in steps(batches, size=STEP_BYTES if carry is None else STEP_BYTES // 2):
            cols: dict[str, list] = {o: [] for o in outputs}
            for ids, joined in c.encode([t or "" for t in batch.column(1).to_pylist()]):
                if "n_tokens" in cols:
                    cols["n_tokens"].append(len(ids))
                if "ids" in cols:
                    cols["ids"].append(ids)
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(sha(joined.encode()))
                if "decoded" in cols or "decoded_sha256" in cols:
                    back = c.decode(ids)
                    if "decoded" in cols:
                        cols["decoded"].append(back)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(sha(back.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, arrow_types[o]) for o, v in cols.items())], [key, *outputs])
        if carry is not None:
            c.rest(carry)

    arrow_types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int64()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
    return df.select(df[key].alias(key), df[text].alias("text")).mapInArrow(run if carry is None else lean(run), f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{o} {TYPES[o]}" for o in outputs))


def rank_file() -> tuple[str, str]:
    """Path and splitting pattern of the multilingual public rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, *rank_file(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
