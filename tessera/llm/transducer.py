"""A byte-pair tokenizer compiled to a deterministic, integer-weighted transducer.

The vocabulary file describes a BPE model whose last symbol of a word carries an end mark.  A
sequence of tokens is the model's segmentation of a string exactly when every adjacent pair of
tokens is the segmentation of its own concatenation, so the segmentation of a prefix is fixed by
its last token, and what later symbols can still change is finite: for every suffix that may yet
grow into a token, the token that ends where this suffix begins and how many tokens lie between.
Those facts are the states.  A transition reads one byte (flagged if it begins a word) and is
annotated with the change of the token count; each state also knows what ending the word there
adds, the last token so far and the token that would close the word.

States and transitions are compiled when first met and kept per Python worker.  A stream runs in
blocks; between blocks a machine with more than ``max_transitions`` starts afresh and compiles only
the state it stands in, so memory is bounded by that number and one block, for any input.

A block is cut into equal chunks that run in lockstep.  Where a word begins inside a chunk the state
after it does not depend on the chunk's entry, so such a chunk's map is constant but for its head.
A chunk without a word start maps entry states to exit states.  Its map is known at the entries met
so far: first at a guess, the state that a short run-up through the bytes before it gives, then at
the exits of the chunk before it.  The maps are composed by a parallel prefix scan (pointers are
doubled), and entries that the scan finds missing are added, until all chunks are resolved.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from .hashing import mixed

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_START = 256
_SYM_BITS = 9
_STATE_BITS = 22
_WEIGHT_BITS = 8
_VAL_BITS = _STATE_BITS + _WEIGHT_BITS
_VAL_MASK = (1 << _VAL_BITS) - 1
_STATE_MASK = (1 << _STATE_BITS) - 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_END = "</w>"
# A fact in one integer: node of the suffix, token before it, tokens between less tokens so far.
_TOKEN_BITS, _LESS_BITS = 20, 12
_NODE_SHIFT = _TOKEN_BITS + _LESS_BITS
_TOKEN_MASK, _LESS_MASK, _LESS_ZERO = (1 << _TOKEN_BITS) - 1, (1 << _LESS_BITS) - 1, 1 << (_LESS_BITS - 1)
_TAIL_MASK = (1 << _NODE_SHIFT) - 1
_NOTHING = _TOKEN_MASK  # "the token before" at a word's start
_ROOT = _NOTHING << _LESS_BITS | _LESS_ZERO
_NEVER = 1 << 40


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte (a fixed alphabet)."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    kept, out, extra = set(shown), [], 0
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(n, len(self.data) // 2 * 3) - len(self.data), self.data.dtype)])
        self.data[self.n : n] = values
        self.n = n


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places begin[i] .. begin[i]+count[i]-1 in a row, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) + (begin - (np.cumsum(count) - count))[owner], owner


def _firsts(owner: np.ndarray) -> np.ndarray:
    """Places where a new owner begins."""
    return np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner


class Merges:
    """The model's merges as numbers: which tokens the model makes, and which pairs stay apart."""

    def __init__(self, model: dict):
        ids: dict[str, int] = model["vocab"]
        n = max(ids.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, both = (np.array([ids[x] for x in side], np.int64).reshape(-1) for side in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        rank = np.full(n, -1, np.int64)
        rank[both] = np.arange(len(both))
        if len(np.unique(both)) < len(both) or (np.maximum(rank[left], rank[right]) >= np.arange(len(both))).any():
            raise ValueError("merges must each make a new token of earlier ones")
        order = np.argsort(left << _TOKEN_BITS | right)
        self._pair, self._pair_rank = (left << _TOKEN_BITS | right)[order], order
        part = np.full((2, n), -1, np.int64)
        part[:, both] = left, right
        self._ends, self._begins = self._spines(part[1], rank), self._spines(part[0], rank)
        self.whole = np.ones(n, bool)
        self.whole[both] = self._apart(left, right, np.arange(len(both)))
        for a, b, t in zip(left.tolist(), right.tolist(), both.tolist(), strict=True):
            if not (self.whole[a] and self.whole[b]):
                self.whole[t] = False

    @staticmethod
    def _spines(part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """The tokens at one end of each token's tree, with the place of the merge that uses each up."""
        own = token = np.arange(len(part))
        limit = np.full(len(part), _NEVER)
        rows = []
        while own.size:
            rows.append((own, token, limit))
            go = part[token] >= 0
            own, limit, token = own[go], rank[token[go]], part[token[go]]
        own, token, limit = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(part))
        return np.cumsum(count) - count, count, token[order].astype(np.int32), limit[order]

    def _apart(self, x: np.ndarray, y: np.ndarray, but: np.ndarray | None = None) -> np.ndarray:
        """Whether nothing is merged across the border of x and y (but for the merge in place ``but``).

        A merge crosses it if it joins an end of x and a beginning of y before either is used up; of
        equal merges the left one comes first.
        """
        (x_at, x_n, x_token, x_until), (y_at, y_n, y_token, y_until) = self._ends, self._begins
        across = y_n[y]
        k, owner = _ranges(np.zeros(len(x), np.int64), x_n[x] * across)
        i, j = x_at[x][owner] + k // across[owner], y_at[y][owner] + k % across[owner]
        pair = x_token[i].astype(np.int64) << _TOKEN_BITS | y_token[j]
        at = np.minimum(np.searchsorted(self._pair, pair), len(self._pair) - 1)
        hit = np.flatnonzero(self._pair[at] == pair)
        rank, own = self._pair_rank[at[hit]], owner[hit]
        bad = (rank < x_until[i[hit]]) & (rank <= y_until[j[hit]])
        if but is not None:
            bad &= rank != but[own]
        out = np.ones(len(x), bool)
        out[own[bad]] = False
        return out

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the whole token before it (_NOTHING at a word's start)."""
        out = self.whole[token]
        after = np.flatnonzero(out & (before != _NOTHING))
        out[after] = self._apart(before[after], token[after])
        return out


class Transducer:
    """Compiled tokenizer; ``path`` is a tokenizers JSON file with a word-end BPE model."""

    def __init__(self, path: str, max_transitions: int = 1_000_000, chunk: int = 32, block: int = 1 << 19, run_up: int = 48):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
            raise ValueError("the transducer is compiled from a BPE model with word-end symbols")
        self.path, self.chunk, self.max_transitions, self.run_up = path, chunk, max_transitions, run_up
        self.block = max(chunk, block // chunk * chunk)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.merges = Merges(model)
        self._plant(model["vocab"])
        # the library's normalizer and pre-tokenizer without its vocabulary
        self._rules = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lowered: dict[int, str] = {}
        self._learn(range(128))
        self._reset()

    @cached_property
    def library(self):
        """The library's own tokenizer of the same file."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plant(self, ids: dict[str, int]) -> None:
        """A trie of the tokens: children, and each node's token, closing token and depth."""
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        child: dict[int, int] = {}
        token, closing, depth, grows = [-1], [-1], [0], [False]
        for text, i in ids.items():
            ends = text.endswith(_END) and len(text) > len(_END)
            body = text[: -len(_END)] if ends else text
            if any(c not in byte_of for c in body):
                continue  # no bytes make it: an added token
            node = 0
            for c in body:
                grows[node] = node > 0
                key = node << 8 | byte_of[c]
                if (below := child.get(key)) is None:
                    below = child[key] = len(token)
                    for column, value in ((token, -1), (closing, -1), (depth, depth[node] + 1), (grows, False)):
                        column.append(value)
                node = below
            if ends:
                closing[node], grows[node] = i, True
            else:
                token[node] = i
        self.child_key = np.array(sorted(child), np.int64)
        self.child = np.array([child[k] for k in self.child_key.tolist()], np.int32)
        self.token_of, self.closing_of, self.grows = np.array(token, np.int32), np.array(closing, np.int32), np.array(grows)
        self.depth = np.array(depth, np.int16)
        self.length_of = np.zeros(max(ids.values()) + 1, np.int16)
        inner = self.token_of >= 0
        self.length_of[self.token_of[inner]] = self.depth[inner]

    # -- alphabet ---------------------------------------------------------------------------

    def _learn(self, points) -> None:
        """Class and lower case of code points, as the library's own components have them."""
        norm, pre = self._rules.normalizer, self._rules.pre_tokenizer
        for p in points:
            c = chr(p)
            own = norm.normalize_str(c)
            pieces = len(pre.pre_tokenize_str(c + c))
            if own == " " or not pieces:
                self.kind[p] = SPACE
            elif pieces == 2:
                self.kind[p] = DIGIT
            else:
                self.kind[p] = LETTER if len(pre.pre_tokenize_str("a" + c)) == 1 else OTHER
            if own != c.lower() and own != " " and unicodedata.normalize("NFC", c) == c:
                self.lowered[p] = own

    def normalise(self, text: str) -> str:
        """The library's normal form, but for white space, which only separates."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = points[self.kind[points] == UNKNOWN]
        if new.size:
            self._learn(np.unique(new).tolist())
        if "Σ" in text:  # lower case here does not look at neighbours
            text = text.replace("Σ", "σ")
        if self.lowered:
            text = text.translate(self.lowered)
        text = text.lower()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = points[self.kind[points] == UNKNOWN]
        if new.size:
            self._learn(np.unique(new).tolist())
        return text

    # -- the machine ------------------------------------------------------------------------

    def _reset(self) -> None:
        self.facts, self.first = Growing(np.int64), Growing(np.int64)  # a state's facts begin at its first
        self.prints, self.slots = Growing(np.uint64), np.zeros(1 << 14, np.int32)
        self.last, self.final, self.end_weight = Growing(np.int32), Growing(np.int32), Growing(np.int16)
        self.last_len, self.final_len = Growing(np.int16), Growing(np.int16)
        # state 0: inside a word whose start is not known; state 1: before a word
        self.facts.extend(np.array([_ROOT]))
        self.first.extend(np.array([0, 0, 1]))
        self.prints.extend(np.zeros(2, np.uint64))
        for column in (self.last, self.last_len, self.final, self.final_len, self.end_weight):
            column.extend(np.zeros(2, column.data.dtype))
        self.filled = 0
        self.table = np.zeros(0, np.int64)
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        old = self.table[self.table >= 0]
        self.table = np.full(size, -1, np.int64)
        self.mask, self.shift = size - 1, np.uint64(64 - (size - 1).bit_length())
        self._insert(old)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def _insert(self, entries: np.ndarray) -> None:
        h = self._slot(entries >> _VAL_BITS)
        while entries.size:
            free = self.table[h] < 0
            self.table[h[free]] = entries[free]
            lost = self.table[h] != entries
            entries, h = entries[lost], (h[lost] + 1) & self.mask

    def _find(self, prints: np.ndarray) -> np.ndarray:
        """States by the fingerprints of their facts, 0 where there is none yet."""
        mask = len(self.slots) - 1
        slot = (prints >> np.uint64(64 - mask.bit_length())).astype(np.int64)
        q = self.slots[slot]
        wrong = np.flatnonzero((q != 0) & (self.prints.data[q] != prints))
        while wrong.size:
            slot[wrong] = (slot[wrong] + 1) & mask
            q[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(q[wrong] != 0) & (self.prints.data[q[wrong]] != prints[wrong])]
        return q

    def _enter(self, q: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.prints.data[q] >> np.uint64(64 - mask.bit_length())).astype(np.int64)
        while q.size:
            free = self.slots[slot] == 0
            self.slots[slot[free]] = q[free]
            lost = self.slots[slot] != q
            q, slot = q[lost], (slot[lost] + 1) & mask

    def _states(self, facts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The states with these facts: longest suffix first, the empty one after the last token last.

        States are told apart by 64-bit fingerprints of their facts.
        """
        begin = np.append(0, ends[:-1])
        place = np.arange(len(facts)) - np.repeat(begin, ends - begin)
        parts = mixed(facts.astype(np.uint64) + mixed(place.astype(np.uint64) * _GOLDEN))
        prints = mixed(np.add.reduceat(parts, begin))
        q = self._find(prints)
        fresh = np.flatnonzero(q == 0)
        if fresh.size:
            own, at, same = np.unique(prints[fresh], return_index=True, return_inverse=True)
            n = self.prints.n
            q[fresh] = n + same
            at = fresh[at]
            chosen, owner = _ranges(begin[at], (ends - begin)[at])
            chain = facts[chosen]
            token = (facts[ends[at] - 1] >> _LESS_BITS & _TOKEN_MASK).astype(np.int32)
            node = chain >> _NODE_SHIFT
            closing = self.closing_of[node]
            fit = np.flatnonzero(closing >= 0)
            fit = fit[self.merges.fits(chain[fit] >> _LESS_BITS & _TOKEN_MASK, closing[fit])]
            lead = fit[_firsts(owner[fit])]
            if len(lead) < len(at):
                raise ValueError("no token closes this word")
            self.facts.extend(chain)
            self.first.extend(self.first.data[self.first.n - 1] + np.cumsum((ends - begin)[at]))
            self.prints.extend(own)
            self.last.extend(token)
            self.last_len.extend(self.length_of[token])
            self.final.extend(closing[lead])
            self.final_len.extend(self.depth[node[lead]])
            self.end_weight.extend((chain[lead] & _LESS_MASK) - _LESS_ZERO + 1)
            fresh = np.arange(n, self.prints.n, dtype=np.int32)
            if self.prints.n * 2 > len(self.slots):
                self.slots = np.zeros(len(self.slots) * 4, np.int32)
                fresh = np.arange(2, self.prints.n, dtype=np.int32)
            self._enter(fresh)
        return q

    def _chains(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The facts of states, one after the other, and whose each is."""
        begin = self.first.data[q]
        at, owner = _ranges(begin, self.first.data[q + 1] - begin)
        return self.facts.data[at], owner

    def _compile(self, keys: np.ndarray) -> None:
        """Adds the transitions of distinct (state, symbol) keys and the states they lead to."""
        starts = keys & _START > 0
        entries = keys << _VAL_BITS | 128 << _STATE_BITS  # nothing is known of a word without its start
        live = np.flatnonzero(starts | (keys >> _SYM_BITS > 0))
        if live.size:
            facts, owner = self._chains(np.where(starts[live], 1, keys[live] >> _SYM_BITS))
            wanted = facts >> _NODE_SHIFT << 8 | (keys[live] & 255)[owner]
            at = np.minimum(np.searchsorted(self.child_key, wanted), len(self.child) - 1)
            below = np.where(self.child_key[at] == wanted, self.child[at], 0).astype(np.int64)
            token = self.token_of[below]
            fit = np.flatnonzero(token >= 0)
            fit = fit[self.merges.fits(facts[fit] >> _LESS_BITS & _TOKEN_MASK, token[fit])]
            lead = fit[_firsts(owner[fit])]
            if len(lead) < len(live):
                raise ValueError("a byte without a token")
            weight = (facts[lead] & _LESS_MASK) - _LESS_ZERO + 1
            grown = np.flatnonzero(self.grows[below])
            ends = np.cumsum(np.bincount(owner[grown], minlength=len(live)) + 1)
            chains, inner = np.empty(ends[-1], np.int64), np.ones(ends[-1], bool)
            inner[ends - 1] = False
            chains[inner] = (below[grown] << _NODE_SHIFT) + (facts[grown] & _TAIL_MASK) - weight[owner[grown]]
            chains[ends - 1] = token[lead].astype(np.int64) << _LESS_BITS | _LESS_ZERO
            entries[live] += (weight << _STATE_BITS) + self._states(chains, ends)
        self.filled += len(keys)
        if self.filled * 1.6 > self.mask:
            self._table((self.mask + 1) * (4 if self.filled < 100_000 else 2))
        self._insert(entries)

    def _look(self, key: np.ndarray) -> np.ndarray:
        """State and weight after each (state, symbol)."""
        h = self._slot(key)
        e = self.table[h]
        wrong, absent = np.flatnonzero((e >> _VAL_BITS) != key), []
        while wrong.size:
            none = e[wrong] < 0
            if none.any():
                absent.append(wrong[none])
                wrong = wrong[~none]
            h[wrong] = (h[wrong] + 1) & self.mask
            e[wrong] = self.table[h[wrong]]
            wrong = wrong[(e[wrong] >> _VAL_BITS) != key[wrong]]
        out = e & _VAL_MASK
        if absent:
            at = np.concatenate(absent)
            self._compile(np.unique(key[at]))
            out[at] = self._look(key[at])
        return out

    def run(self, sym: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of the stream: where each begins, the state after each byte and its transition's weight.

        States are numbers of this block's machine; look them up in ``tables`` before the next block.
        """
        q = 0
        for begin in range(0, len(sym), self.block):
            if self.filled > self.max_transitions:
                chain = self._chains(np.array([q]))[0]
                self._reset()
                q = int(self._states(chain, np.array([len(chain)]))[0]) if len(chain) else 0
            states, weights = self._lockstep(sym[begin : begin + self.block], q)
            q = int(states[-1])
            weights -= 128
            yield begin, states, weights

    def _lockstep(self, sym: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(sym), self.chunk
        lanes = -(-n // width)
        rows = np.full(lanes * width, _START | 32, np.int64)
        rows[:n] = sym
        rows = np.ascontiguousarray(rows.reshape(lanes, width).T)
        states = np.empty((width, lanes), np.int32)
        weights = np.empty((width, lanes), np.int16)
        q = np.zeros(lanes, np.int64)
        q[0] = entry
        for t in range(width):
            v = self._look((q << _SYM_BITS) | rows[t])
            q = v & _STATE_MASK
            states[t], weights[t] = q, v >> _STATE_BITS
        states, weights = states.T.ravel()[:n], weights.T.ravel()[:n]
        self._heads(sym, states, weights, lanes)
        return states, weights

    def _heads(self, sym: np.ndarray, states: np.ndarray, weights: np.ndarray, lanes: int) -> None:
        """Runs each chunk's head, the bytes before its first word start, from the chunk's entry."""
        n, width = len(sym), self.chunk
        first = np.arange(1, lanes, dtype=np.int64) * width
        first = first[(sym[first] & _START) == 0]
        if not first.size:
            return
        stop = np.minimum(first + width, n)
        entry = states[first - 1].astype(np.int64)
        unknown = entry == 0
        if unknown[0]:
            raise ValueError("the stream must begin with a word start")
        if unknown.any():
            whole = states[stop - 1] == 0
            exits = np.zeros(lanes, np.int64)
            exits[first[whole] // width] = self._scan(sym, first[whole], stop[whole], entry[whole])
            entry[unknown] = exits[first[unknown] // width - 1]
        self._follow(sym, first, stop, entry, states, weights)

    def _follow(self, sym, at, stop, entry, states=None, weights=None) -> np.ndarray:
        """The states after the bytes from ``at`` up to ``stop`` or the next word start, in lockstep."""
        exits, lane = entry.copy(), np.arange(len(at))
        while at.size:
            v = self._look((entry << _SYM_BITS) | sym[at])
            exits[lane] = entry = v & _STATE_MASK
            if states is not None:
                states[at], weights[at] = entry, v >> _STATE_BITS
            go = at + 1 < stop
            go[go] = (sym[at[go] + 1] & _START) == 0
            at, stop, entry, lane = at[go] + 1, stop[go], entry[go], lane[go]
        return exits

    def _scan(self, sym: np.ndarray, first: np.ndarray, stop: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Exit states of chunks without a word start; ``entry`` is 0 where it is the exit of the one before."""
        n = len(first)
        linked = np.append((entry[1:] == 0), False)  # the next chunk's entry is this one's exit
        known = np.flatnonzero(entry)
        guessed = np.flatnonzero(entry == 0)
        near = min(self.run_up, 2 * self.chunk)
        q = np.zeros(len(guessed), np.int64)
        for t in range(-near, 0):
            v = self._look((q << _SYM_BITS) | sym[first[guessed] + t] | (_START if t == -near else 0))
            q = v & _STATE_MASK
        new = np.sort(np.concatenate([known << _STATE_BITS | entry[known], guessed << _STATE_BITS | q]))
        key = exits = np.zeros(0, np.int64)
        while True:
            own = new >> _STATE_BITS
            key = np.concatenate([key, new])
            exits = np.concatenate([exits, self._follow(sym, first[own], stop[own], new & _STATE_MASK)])
            order = np.argsort(key)
            key, exits = key[order], exits[order]
            own = key >> _STATE_BITS
            wanted = own + 1 << _STATE_BITS | exits
            to = np.searchsorted(key, wanted)
            met = linked[own] & (key[np.minimum(to, len(key) - 1)] == wanted)
            jump = np.append(np.where(met, to, len(key)), len(key))
            reached = np.zeros(len(key) + 1, bool)
            reached[np.searchsorted(key, known << _STATE_BITS | entry[known])] = True
            for _ in range(n.bit_length()):  # after k turns: all within 2**k chunks
                reached[jump[np.flatnonzero(reached)]] = True
                jump = jump[jump]
            reached = reached[:-1]
            if reached.sum() == n:
                return exits[reached]
            new = np.unique(wanted[linked[own] & ~met])

    def tables(self) -> tuple[np.ndarray, ...]:
        """By state: last token and its bytes, closing token and its bytes, what closing adds."""
        return self.last.data, self.last_len.data, self.final.data, self.final_len.data, self.end_weight.data

    # -- texts ------------------------------------------------------------------------------

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flagged bytes of the words of the texts, and where each text ends in them."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        kind = self.kind[:256][data]
        tail = data >= 0x80
        if tail.any():
            self._wide(data, kind)
        start = np.empty(len(kind), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        digit = kind == DIGIT
        if tail.any():
            digit &= (data & 0xC0) != 0x80
        start |= digit
        at = np.flatnonzero((data == 39) & start)
        if at.size:
            self._contractions(data, start, at)
        word = kind != SPACE
        sym = (data.astype(np.int16) | (start.astype(np.int16) << 8))[word]
        return sym, np.cumsum(word)[ends - 1]

    def _wide(self, data: np.ndarray, kind: np.ndarray) -> None:
        """Gives all bytes of each character beyond ASCII the character's class."""
        for low, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            at = np.flatnonzero((data >= low) & (data < (0xE0, 0xF0, 0x100)[size - 2]))
            if at.size:
                point = (data[at] & (0x7F >> size)).astype(np.int64)
                for k in range(1, size):
                    point = (point << 6) | (data[at + k] & 0x3F)
                own = self.kind[point]
                for k in range(size):
                    kind[at + k] = own

    @staticmethod
    def _contractions(points: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
        """An apostrophe that begins a run takes s, t, m, d, re, ve or ll with it."""
        n = len(points)
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long &= ~short
        start[at[short] + 1] = False
        start[at[long] + 1] = False
        start[np.minimum(at[short] + 2, n - 1)] = True
        start[np.minimum(at[long] + 3, n - 1)] = True

    def _stretches(self, texts: list[str | None]) -> Iterator[tuple[str, int, int]]:
        """Normal forms of the stretches between special strings, cut at blanks where they are long;
        each with its text's number and the special string after it (0: none, id + 1)."""
        for i, text in enumerate(texts):
            text, begin = text or "", 0
            if any(s in text for s in self.special):
                for found in self._special.finditer(text):
                    for a, b in self._cut(text, begin, found.start()):
                        yield self.normalise(text[a:b]), i, 0 if b < found.start() else self.special[found[0]] + 1
                    begin = found.end()
            for a, b in self._cut(text, begin, len(text)):
                yield self.normalise(text[a:b]), i, 0

    def _cut(self, text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
        while b - a > self.block:
            k = max(text.rfind(" ", a + 1, a + self.block), text.rfind("\n", a + 1, a + self.block))
            if k < 0:  # one very long word
                k = min((x for s in " \n" if (x := text.find(s, a + self.block, b)) >= 0), default=b)
            if k == b:
                break
            yield a, k
            a = k
        yield a, b

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        parts, of, after, size = [], [], [], 0
        for part, i, special in self._stretches(texts):
            if parts and size + len(part) > self.block:
                yield parts, np.array(of), np.array(after)
                parts, of, after, size = [], [], [], 0
            parts.append(part), of.append(i), after.append(special)
            size += len(part) + 1
        if parts:
            yield parts, np.array(of), np.array(after)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        total = np.zeros(len(texts), np.int64)
        for parts, of, after in self._groups(texts):
            sym, through = self.stream(parts)
            tokens = np.zeros(len(sym) + 1, np.int64)
            for begin, states, weights in self.run(sym):
                own = tokens[begin + 1 : begin + 1 + len(states)]
                own[:] = weights
                closes = _closes(sym, begin, len(states))
                own[closes] += self.tables()[4][states[closes]]
            tokens = np.cumsum(tokens, out=tokens)[np.concatenate([[0], through])]
            np.add.at(total, of, np.diff(tokens) + (after > 0))
        return total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text ends in them."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        for parts, of, after in self._groups(texts):
            ids, ends = self._ids(*self.stream(parts))
            np.add.at(sizes, of, np.diff(ends, prepend=0) + (after > 0))
            out.append(np.insert(ids, ends[after > 0], after[after > 0] - 1))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.cumsum(sizes)

    def _ids(self, sym: np.ndarray, through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a stream, found backwards in all words at once, and where each text ends in them."""
        if not len(sym):
            return np.zeros(0, np.int32), np.zeros(len(through), np.int64)
        last, last_len, tokens = np.empty(len(sym), np.int32), np.empty(len(sym), np.int16), np.empty(len(sym), np.int16)
        final, final_len = [], []
        for begin, states, weights in self.run(sym):
            own = slice(begin, begin + len(states))
            tables = self.tables()
            last[own], last_len[own], tokens[own] = tables[0][states], tables[1][states], weights
            closes = _closes(sym, begin, len(states))
            final.append(tables[2][states[closes]])
            final_len.append(tables[3][states[closes]])
            tokens[begin + closes] += tables[4][states[closes]]
        begins = np.flatnonzero(sym & _START)
        upto = np.cumsum(np.add.reduceat(tokens, begins, dtype=np.int64))
        out = np.empty(int(upto[-1]), np.int32)
        place = upto - 1
        out[place] = np.concatenate(final)
        at = np.append(begins[1:], len(sym)) - 1 - np.concatenate(final_len)
        floor = begins
        while at.size:
            go = at >= floor
            at, place, floor = at[go], place[go] - 1, floor[go]
            out[place] = last[at]
            at = at - last_len[at]
        return out, np.concatenate([[0], upto])[np.searchsorted(begins, through)]


def _closes(sym: np.ndarray, begin: int, n: int) -> np.ndarray:
    """Places in a block of the stream where a word ends."""
    after = sym[begin + 1 : begin + n + 1]
    ends = np.flatnonzero(after & _START)
    return ends if begin + n < len(sym) else np.append(ends, n - 1)


_MACHINES: dict[str, Transducer] = {}


def forget() -> None:
    """Drops what this worker has compiled, before work that needs the memory for something else."""
    _MACHINES.clear()


def machine(path: str) -> Transducer:
    """The worker's own compiled tokenizer, kept between tasks."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]
