"""Token counts by a compiled finite-state transducer.

The tokenizer (byte-level BPE behind the usual splitting pattern) is compiled, state by state as
texts need them, into a deterministic transducer over bytes whose transitions carry the change of
the token count. A state knows what can still matter: which kind of run the splitter is in, and for
every place in the run from which a vocabulary entry could still grow, its node in the vocabulary's
trie, the count so far, and the token that ends there or, deeper in the trie, which of the tokens
below the node may follow it. As the last token of every prefix of a run is the only one that may
follow the token before it, these items decide all later counts.

Texts are cut into chunks. A chunk's map takes the states it may start in to its end state and
count: the state at the start of a run, and what the chunk before it ends in from its own first
states. All chunks are run in step for one of these states at a time. A parallel prefix scan then composes the
maps pairwise, over spans of 1, 2, 4, ... chunks, in as many passes as the logarithm of their
number; the first chunk of a text maps every state alike, so that a text never hangs on the one before
it. Where a chain leaves the states that a map knows, the rest of that text is run through once, byte
by byte: the work is linear in a text's length whatever it holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices, utf8

CHUNK = 512
STARTS = 3            # start states in a chunk's map
MAX_STATES = 60_000   # states (1 KB each) at which the compiled table is begun anew with those in use
_HALF = 64            # a transition is next state * 2 * _HALF + (change of count + _HALF)

SMALL = 32            # tokens of a subtree that is told by which of them may follow

START, RUN, BLANKS, QUOTE, QUOTE2, PART = range(6)
LETTER, NUMBER, OTHER, BLANK = range(4)
#: The suffixes that the splitting pattern cuts off after an apostrophe.
SHORT, LONG = ("s", "t", "m", "d"), {"r": "e", "v": "e", "l": "l"}


def _byte_letters() -> dict[str, int]:
    """The usual one-to-one table of printable letters for bytes: printable Latin-1 stands for
    itself, the other bytes for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"], split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), spec["normalizer"]) != ("BPE", "ByteLevel", False, True, None) or any(
                model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is compiled")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain strings")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        letters = _byte_letters()
        added = {t["content"] for t in spec["added_tokens"]}
        self.text = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in added}
        ids = {t: i for i, t in self.text.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        # a token's edges: what stands at its right and left edge while it is merged, and the rank
        # of the merge that takes it away (none takes the whole token)
        made = {new: (rank, a, b) for (a, b), (rank, new) in sorted(self.merges.items(), key=lambda x: -x[1][0])}
        self.right, self.left = ({i: self._edge(made, i, side) for i in self.text} for side in (2, 1))
        # the vocabulary as a trie: (node, byte) -> node; node 0 is the root; a node's tokens are a
        # range of the tokens in byte order, of which the first may be the node's own
        self.order = sorted(self.text, key=self.text.__getitem__)
        self.trie: dict[int, int] = {}
        self.token, self.low, self.high = [-1], [0], [0]
        for place, i in enumerate(self.order):
            node = 0
            self.high[0] = place + 1
            for byte in self.text[i]:
                nxt = self.trie.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.trie[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.low.append(place)
                    self.high.append(place)
                node = nxt
                self.high[node] = place + 1
            self.token[node] = i
        self.kinds: dict[str, int] = {}
        self._steps: dict = {}
        self._masks: dict[int, int] = {}
        self._clear()

    # ------------------------------------------------------------ what a merge leaves
    def bpe(self, tokens: list[int]) -> list[int]:
        """Merge by rank until nothing merges."""
        tokens = list(tokens)
        while len(tokens) > 1:
            best = min((self.merges.get(p, (1 << 60, 0)) for p in zip(tokens, tokens[1:])))
            if best[0] == 1 << 60:
                break
            out, k = [], 0
            while k < len(tokens):
                if k + 1 < len(tokens) and self.merges.get((tokens[k], tokens[k + 1]), (-1,))[0] == best[0]:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
        return tokens

    def _edge(self, made: dict, token: int, side: int) -> list[tuple[int, int]]:
        out, gone = [], 1 << 60
        while True:
            out.append((token, gone))
            if token not in made or len(self.text[token]) == 1:
                return out
            gone, token = made[token][0], made[token][side]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two stay as they are next to each other (before < 0: at a run's start): no
        pair of their edges merges while both are there (of equal ranks the left merge is first)."""
        if before < 0:
            return self.bpe([self.single[b] for b in self.text[token]]) == [token]
        merges, none, right = self.merges, (1 << 61, 0), self.right[before]
        for y, y_gone in self.left[token]:
            for x, x_gone in right:
                rank = merges.get((x, y), none)[0]
                if rank < x_gone and rank <= y_gone:
                    return False
        return True

    def _item(self, node: int, before: int) -> tuple[int, int, int] | None:
        """What matters of a place where ``before`` ends and from which ``node`` has been read: in a
        small subtree, which of its tokens (bit k: the k-th one below) may follow; else ``before``."""
        low = self.low[node] + (self.token[node] >= 0)
        if self.high[node] - low > SMALL:
            return (node, before, -1)
        key = node << 20 | before + 1
        if (mask := self._masks.get(key)) is None:
            mask = self._masks[key] = sum(1 << k for k, t in enumerate(self.order[low:self.high[node]]) if self.may_follow(before, t))
        return (node, 0, mask) if mask else None

    def step(self, items: tuple, byte: int) -> tuple[tuple, int]:
        """Items after one more byte of a run, and the change of its count."""
        if (known := self._steps.get((items, byte))) is not None:
            return known
        grown, last, change = [], -1, 0
        for node, before, mask, count in items:
            nxt = self.trie.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token[nxt]
            if mask < 0:
                if token >= 0 and self.may_follow(before, token):
                    last, change = token, count + 1
                item = self._item(nxt, before)
            else:
                mask >>= self.low[nxt] - self.low[node] - (self.token[node] >= 0)
                if token >= 0:
                    if mask & 1:
                        last, change = token, count + 1
                    mask >>= 1
                mask &= (1 << (self.high[nxt] - self.low[nxt] - (token >= 0))) - 1
                item = (nxt, 0, mask) if mask else None
            if item:
                grown.append((*item, count))
        if last < 0:
            raise AssertionError("no token ends here")
        out = (*((n, b, m, c - change) for n, b, m, c in grown), (0, last, -1, 0)), change
        self._steps[items, byte] = out
        return out

    def steps(self, items: tuple, data: bytes) -> tuple[tuple, int]:
        total = 0
        for byte in data:
            items, change = self.step(items, byte)
            total += change
        return items, total

    # ------------------------------------------------------------ splitter and runs together
    def kind(self, char: str) -> int:
        """The splitter's kind of a character, asked from the library."""
        if (known := self.kinds.get(char)) is None:
            joins = [k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.splitter.pre_tokenize_str(c + char)) == 1]
            known = self.kinds[char] = joins[0] if joins else BLANK
        return known

    def character(self, state: tuple, char: str) -> tuple[tuple, int]:
        """State after a character, and the change of the count that holds if the text ends there."""
        data, kind, fresh = char.encode(), self.kind(char), ((0, -1, -1, 0),)
        what = state[0]
        if what == RUN and kind == state[1]:
            items, change = self.steps(state[2], data)
            return (RUN, kind, items), change
        if what == BLANKS:
            if kind == BLANK:
                items, change = self.steps(state[1], data)
                return (BLANKS, items, change, char), change
            # the run keeps all but its last character, which goes with what follows if it is a space
            items, last = self.steps(fresh, state[3].encode())
            if state[3] == " ":
                items, change = self.steps(items, data)
                return (RUN, kind, items), last + change - state[2]
            after, change = self.character((START,), char)
            return after, last + change - state[2]
        if what == QUOTE:
            if char in SHORT:
                return (START,), self.steps(state[1], data)[1]
            if char in LONG:
                return (QUOTE2, char), self.steps(fresh, data)[1]
            if kind == OTHER:
                items, change = self.steps(state[1], data)
                return (RUN, OTHER, items), change
        if what == QUOTE2:
            first = state[1]
            if char == LONG[first]:
                return (START,), self.steps(fresh, b"'" + first.encode() + data)[1] - self.steps(fresh, b"'")[1] - self.steps(fresh, first.encode())[1]
            return self.character((RUN, LETTER, self.steps(fresh, first.encode())[0]), char)
        items, change = self.steps(fresh, data)
        if kind == BLANK:
            return (BLANKS, items, change, char), change
        return ((QUOTE, items) if char == "'" else (RUN, kind, items)), change

    def _byte(self, state: tuple, byte: int) -> tuple[tuple, int]:
        if state[0] == PART:
            part = state[2] + bytes([byte])
            if len(part) < state[3]:
                return (PART, state[1], part, state[3]), 0
            return self.character(state[1], part.decode(errors="replace"))
        if byte < 0x80:
            return self.character(state, chr(byte))
        return (PART, state, bytes([byte]), 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4), 0

    # ------------------------------------------------------------ table
    def _clear(self) -> None:
        self.states: list[tuple] = [(START,)]
        self.number: dict[tuple, int] = {(START,): 0}
        self.table = np.full(1024 * 256, -1, np.int32)
        self._steps.clear()
        self._masks.clear()

    def _renew(self, held: list[np.ndarray]) -> None:
        """Begin the table anew with the states that the arrays hold (-1: none), and renumber these in place."""
        used = np.unique(np.concatenate([a.ravel() for a in held]))
        used = used[used > 0]
        states = [self.states[k] for k in used.tolist()]
        self._clear()
        for state in states:
            self._number(state)
        for a in held:
            new = np.searchsorted(used, a) + 1
            a[...] = np.where(a > 0, new, a)

    def _number(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            while number * 256 >= len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return number

    def _compile(self, state: int, byte: int) -> None:
        after, change = self._byte(self.states[state], byte)
        if not -_HALF <= change < _HALF:
            raise OverflowError(f"a change of {change} tokens in one byte")
        number = self._number(after)
        self.table[state * 256 + byte] = number * (2 * _HALF) + change + _HALF

    def moves(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        at = states * 256 + data
        found = self.table[at]
        if (found < 0).any():
            for key in np.unique(at[found < 0]).tolist():
                self._compile(key >> 8, key & 255)
            found = self.table[at]
        return found

    # ------------------------------------------------------------ chunks
    def _run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of each chunk data[start:end] from its state, all chunks in step. ``held`` are the
        caller's arrays of states."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        size, at, state = size[order], start[order], state[order].astype(np.int64)
        count = np.zeros(len(size), np.int64)
        running = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # chunks longer than j
        for j, n in enumerate(running.tolist()):
            if len(self.states) > MAX_STATES:
                self._renew([state, *held])
            found = self.moves(state[:n], data[at[:n] + j])
            state[:n] = found // (2 * _HALF)
            count[:n] += found % (2 * _HALF) - _HALF
        final, counts = np.empty_like(state), np.empty_like(count)
        final[order], counts[order] = state, count
        return final, counts

    def _walk(self, data: np.ndarray, start: int, end: int, state: int, held: list[np.ndarray]) -> int:
        """Count of data[start:end] from a state, byte by byte."""
        count, table = 0, memoryview(self.table)
        for byte in data[start:end].tobytes():
            found = table[state << 8 | byte]
            if found < 0:
                if len(self.states) > MAX_STATES:
                    now = np.array([state])
                    self._renew([now, *held])
                    state = int(now[0])
                self._compile(state, byte)
                table = memoryview(self.table)
                found = table[state << 8 | byte]
            state = found // (2 * _HALF)
            count += found % (2 * _HALF) - _HALF
        return count

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts data[offsets[k]:offsets[k + 1]]."""
        if len(self._masks) + len(self._steps) > 4 * MAX_STATES:  # these only save time
            self._masks.clear()
            self._steps.clear()
        out = np.zeros(len(offsets) - 1, np.int64)
        bounds, texts = self._segments(data, offsets, out)
        if not len(bounds):
            return out
        start, end, owner = self._chunks(data, bounds)
        first = np.append(True, owner[1:] != owner[:-1])
        entry, final, counts = self._maps(data, start, end, first)
        final, counts = _scan(entry, final, counts, first)
        last = np.flatnonzero(np.append(first[1:], True))
        total = counts[last]
        lost = np.flatnonzero(final < 0)
        if len(lost):  # the first chunk of each text that a chain could not enter, and the rest of the text
            of, where = np.unique(owner[lost], return_index=True)
            for text, k in zip(of.tolist(), lost[where].tolist(), strict=True):
                total[text] = counts[k - 1] + self._walk(data, int(start[k]), int(bounds[text, 1]), int(final[k - 1]), [final])
        np.add.at(out, texts, total)
        return out

    def _maps(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start states, end states, counts), each chunks x STARTS; -1: no state."""
        n = len(start)
        entry, final, counts = np.full((n, STARTS), -1, np.int64), np.full((n, STARTS), -1, np.int64), np.zeros((n, STARTS), np.int64)
        held = [entry, final]
        entry[:, 0] = 0  # chunks begin after a run where they can
        final[:, 0], counts[:, 0] = self._run(data, start, end, entry[:, 0], held)
        for d in range(1, STARTS):
            if len(self.states) > MAX_STATES:
                self._renew(held)
            before = np.append(-1, final[:-1, d - 1])
            new = np.flatnonzero(~first & (before >= 0) & (entry[:, :d] != before[:, None]).all(1))
            if not len(new):
                break
            entry[new, d] = before[new]
            same = self.moves(entry[new, d], data[start[new]]) == self.moves(entry[new, 0], data[start[new]])
            like, other = new[same], new[~same]  # the first byte leads both states to one, with one count
            final[like, d], counts[like, d] = final[like, 0], counts[like, 0]
            ends, found = self._run(data, start[other], end[other], entry[other, d], held)
            final[other, d], counts[other, d] = ends, found
        return entry, final, counts

    def _segments(self, data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nonempty stretches between special strings, each of which is one token: (start, end)
        rows, and the text of each."""
        whole = np.column_stack([offsets[:-1], offsets[1:]])
        raw = data.tobytes() if any(len(s) <= len(data) for s in self.special) else b""
        hit = sorted((at, at + len(s)) for s in self.special for at in _places(raw, s))
        if not hit:
            keep = np.flatnonzero(whole[:, 1] > whole[:, 0])
            return whole[keep], keep
        rows, texts, past = [], [], 0
        inside = np.searchsorted(offsets, [h[0] for h in hit], "right") - 1
        held: dict[int, list] = {}
        for (a, b), k in zip(hit, inside.tolist(), strict=True):
            if b <= offsets[k + 1] and a >= past:
                held.setdefault(k, []).append((a, b))
                past = b
        for k, (a, b) in enumerate(whole.tolist()):
            for c, d in [*held.get(k, ()), (b, None)]:
                if c > a:
                    rows.append((a, c))
                    texts.append(k)
                out[k] += d is not None
                a = d
        return np.array(rows, np.int64).reshape(-1, 2), np.array(texts, np.int64)

    @staticmethod
    def _chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of about CHUNK bytes: cut before a space that follows no white space where there
        is one, else anywhere."""
        pieces = np.maximum(1, (bounds[:, 1] - bounds[:, 0]) // CHUNK)
        owner = np.repeat(np.arange(len(bounds)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = bounds[owner, 0] + nth * CHUNK
        blank = (data == 0x20) | (data >= 9) & (data <= 13)
        safe = np.flatnonzero((data[1:] == 0x20) & ~blank[:-1]) + 1
        if len(safe):
            near = safe[np.minimum(np.searchsorted(safe, start), len(safe) - 1)]
            move = (nth > 0) & (near >= start) & (near < start + CHUNK // 2)
            start = np.where(move, near, start)
        end = np.append(start[1:], bounds[-1, 1])
        last = np.append(owner[1:] != owner[:-1], True)
        return start, np.where(last, bounds[owner, 1], end), owner


def _scan(entry: np.ndarray, final: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parallel prefix scan of the chunks' maps: for each chunk the end state and the count from the
    start of its text up to its end; state -1 where a chain left the maps.

    In pass j a chunk's map covers the 2^j chunks up to it, from the start states of the first of
    these. It is composed with the map that ends before that one. Maps that cover the start of a text
    take every state alike, and stay as they are.
    """
    final, counts, fixed = final.copy(), counts.copy(), first.copy()
    final[first], counts[first] = final[first, :1], counts[first, :1]
    span = 1
    while span < len(first) and not fixed.all():
        right = np.flatnonzero(~fixed)
        right = right[right >= span]
        left = right - span
        starts = entry[left + 1]
        came = final[left]
        hit = (came[:, :, None] == starts[:, None, :]) & (came >= 0)[:, :, None]
        known, at = hit.any(2), hit.argmax(2)
        ends = np.where(known, np.take_along_axis(final[right], at, 1), -1)
        sums = counts[left] + np.take_along_axis(counts[right], at, 1)
        done = fixed[left]
        final[right], counts[right] = ends, sums
        fixed[right] = done
        span *= 2
    return final[:, 0], counts[:, 0]


def _places(data: bytes, what: bytes) -> Iterator[int]:
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + len(what))


@lru_cache(maxsize=2)
def _transducer(path: str) -> Transducer:
    return Transducer(path)


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, as the ``tokenizers`` library
    counts them.

    Null and empty texts have 0 tokens. Special strings inside a text are one token each, as by the
    library's default. Repeated rows each have their own row; other columns are ignored; nothing is
    shuffled, and a task holds a few MB of texts (or one longer text) and the compiled table, at most
    MAX_STATES states. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(tokenizer)
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(machine.count(data, offsets))], schema=_COUNTS)

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
