"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The vocabulary is that of a SentencePiece model file. Its pieces don't run over a space's left edge or a line end, so a
text's lattice falls apart into short ones, one for each unit of spaces and the letters after them. Forward filtering
sums the weights of all ways to reach each place of a unit; it is done once for each distinct unit that a task
remembers. Backward sampling then draws, from each unit's end, an arriving piece in proportion to the weight of the ways
through it; all units of a slice take each step at once. The random numbers are 32-bit whole numbers, hashes of the row
key, the unit's number in its text and the step, and shares are 32-bit whole numbers counted within each place, so a
row's segmentation is the same wherever and whenever it is drawn.

Weights: a piece of rank r has alpha * log of its Zipf share 1 / (r + 2); a character without a piece of its own is
written as its UTF-8 bytes' pieces, as is U+2581, which the model would take for a space.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Growing, WordCodes, map_texts, runs, spread, sums

MARK = "▁"
ALPHA = 1.0
SEED = 11
#: Distinct units whose lattices a task remembers, and their pieces' places (arcs), of 10 bytes each.
UNITS_KEPT = 250_000
ARCS_KEPT = 6_000_000
#: Lattices are made for so many characters at once, as their arcs take some hundreds of bytes a character meanwhile; a longer unit is on its own.
GROW_CHARS = 25_000
#: What is remembered of units that stay is moved for so many units at once.
MOVE_UNITS = 5_000
#: Texts are sampled in slices of about so many bytes: a slice's units and pieces take some 30 times as much meanwhile.
SAMPLE_BYTES = 1 << 19
#: Leading bits of a hash by which the table of beginnings of pieces is entered.
HEAD_BITS = 20
#: Shares of arcs are counted in these.
WHOLE = (1 << 32) - 1


def units_in(texts: list) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts, each with a space put before it, and how many each text has: a line end, or spaces and what follows them up to the next."""
    data = np.frombuffer(b"".join([b" " + t for t in texts if t]), np.uint8)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    space, line = data == 0x20, data == 0x0A
    start = line.copy()
    start[1:] |= np.where(space[1:], ~space[:-1], line[:-1])
    start[(ends - lengths)[lengths > 0]] = True
    begins = np.nonzero(start)[0]
    return runs(data, begins), np.searchsorted(begins, ends) - np.searchsorted(begins, ends - lengths)


def characters(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units and how many each has; a byte that isn't UTF-8 is 0xDC00 more than itself."""
    texts = [u.decode("utf-8", "surrogateescape") for u in units]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def utf8_length(chars: np.ndarray) -> np.ndarray:
    n = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    return np.where((chars >= 0xDC80) & (chars < 0xDD00), 1, n)


def utf8_byte(chars: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Byte k of each character, which has n bytes."""
    part = chars >> (6 * (n - 1 - k))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n] | part
    return np.where(n == 1, chars & 0xFF, np.where(k == 0, lead, 0x80 | part & 0x3F))


def mixed(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ chars) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


class Vocabulary:
    """Pieces as plain text (spaces for marks), log weights, and each id's bytes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = np.full(256, -1, np.int32)
        raw: list[bytes] = [b""] * n
        plain = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw[i] = bytes([int(piece[3:5], 16)])
                self.byte[raw[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((-model.get_score(i), i, piece.replace(MARK, " ")))
                raw[i] = plain[-1][2].encode()
        plain.sort()
        total = math.log(sum(1 / (r + 2) for r in range(len(plain))))
        self.pieces = {p: (i, alpha * (-math.log(r + 2) - total)) for r, (_, i, p) in enumerate(plain) if "\n" not in p and (p.strip(" ") == "" or " " not in p[1:])}
        self.longest = max(map(len, self.pieces))
        self.heads, self.piece, self.weight = self.prefix_table()
        self.begin = np.searchsorted(self.heads, np.arange(1 << HEAD_BITS, dtype=np.uint64) << np.uint64(64 - HEAD_BITS))
        self.unknown = alpha * (-math.log(len(plain) + 2) - total)
        self.raw = pa.array(raw, pa.large_binary())

    def prefix_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of all beginnings of pieces; the piece that each one is (-1: none) and its weight."""
        found = {}
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                found.setdefault(p[:k], None)
        names = sorted(found, key=len)
        hashes = np.empty(len(names), np.uint64)
        for k in range(1, self.longest + 1):
            at = [i for i, p in enumerate(names) if len(p) == k]
            chars = np.array([[ord(c) for c in names[i]] for i in at], np.uint64).reshape(-1, k)
            h = np.zeros(len(at), np.uint64)
            for c in chars.T:
                h = mixed(h, c)
            hashes[at] = h
        order = np.argsort(hashes)
        assert len(np.unique(hashes)) == len(names)
        ids = np.array([self.pieces.get(p, (-1, 0.0))[0] for p in names], np.int64)
        weights = np.array([self.pieces.get(p, (-1, 0.0))[1] for p in names])
        last = np.uint64(0xFFFFFFFFFFFFFFFF)
        return np.append(hashes[order], last), np.append(ids[order], -1), np.append(weights[order], 0.0)

    def arcs(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in a run of characters, the longest first: where they start, their lengths, ids (less than 0: the bytes of character -1 - id) and weights.

        left: how many characters of its unit each one has from itself on.
        """
        live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        out, single = [], np.zeros(len(chars), bool)
        wide = chars.astype(np.uint64)
        for k in range(1, self.longest + 1):
            if k > 1:
                fits = left[live] >= k
                live, h = live[fits], h[fits]
            h = mixed(h, wide[live + k - 1])
            at = self.place_of(h)
            known = at >= 0
            live, h, at = live[known], h[known], at[known]
            piece = self.piece[at]
            whole = piece >= 0
            out.append((live[whole], np.full(int(whole.sum()), k), piece[whole], self.weight[at[whole]]))
            if k == 1:
                single[live[whole]] = True
            if not len(live):
                break
        rest = np.nonzero(~single)[0]
        out.insert(0, (rest, np.ones(len(rest), int), -1 - chars[rest].astype(np.int64), self.unknown * utf8_length(chars[rest])))
        return tuple(np.concatenate(x) for x in zip(*out[::-1]))

    def place_of(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands in heads, -1: nowhere. Its leading bits say where to begin; from there on it is a step or few."""
        at = self.begin[(h >> np.uint64(64 - HEAD_BITS)).astype(np.int64)]
        behind = np.nonzero(self.heads[at] < h)[0]
        while len(behind):
            at[behind] += 1
            behind = behind[self.heads[at[behind]] < h[behind]]
        return np.where(self.heads[at] == h, at, -1)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive runs of ids; the leading space that encoding adds goes."""
        if not len(ids):
            return [b""] * len(counts)
        _, offsets, raw = self.raw.take(pa.array(ids)).buffers()
        ends = np.frombuffer(offsets, np.int64)[np.append(0, np.cumsum(counts))].tolist()
        return [raw[a:b].to_pybytes()[1:] for a, b in zip(ends, ends[1:])]


def drawn(keys: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Whole numbers from 0 to WHOLE - 1 from a mixed 64-bit hash of key, place and step."""
    with np.errstate(over="ignore"):
        h = keys + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(32)) * np.uint64(WHOLE) >> np.uint64(32)).astype(np.uint32)


class Sampler:
    """Lattices of the units met so far, as flat arrays of arcs by the place where they end.

    upto: running share of an arc within its place, WHOLE at the place's last; back: its piece's characters; piece: the
    piece. first: each place's first arc. start, size: each unit's first place and its characters.
    """

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.upto, self.back, self.piece = Growing(np.uint32), Growing(np.int16), Growing(np.int32)
        self.first, self.start, self.size = Growing(np.int32), Growing(np.int32), Growing(np.int32)
        self.codes = WordCodes(self.grow, self.restart, UNITS_KEPT, self.retain)

    def restart(self):
        for g in (self.upto, self.back, self.piece, self.first, self.start, self.size):
            g.clear()

    def retain(self, kept: np.ndarray):
        """Moves what is held of these units, in rising order, to the front, some units at a time: all at once it takes as much again."""
        arcs_to = places_to = 0
        n_places, n_arcs = self.first.n, self.upto.n
        for k in range(0, len(kept), MOVE_UNITS):
            some = kept[k : k + MOVE_UNITS]
            size = self.size.all[some].astype(np.int64)
            places = spread(self.start.all[some].astype(np.int64), size + 1)
            first = self.first.all[places].astype(np.int64)
            n = np.where(places + 1 < n_places, self.first.all[np.minimum(places + 1, n_places - 1)], n_arcs) - first
            arcs = spread(first, n)
            for g in (self.upto, self.back, self.piece):
                g.all[arcs_to : arcs_to + len(arcs)] = g.all[arcs]
            self.first.all[places_to : places_to + len(places)] = arcs_to + np.cumsum(n) - n
            self.start.all[k : k + len(some)] = places_to + np.cumsum(size + 1) - size - 1
            self.size.all[k : k + len(some)] = size
            arcs_to, places_to = arcs_to + len(arcs), places_to + len(places)
        self.upto.n = self.back.n = self.piece.n = arcs_to
        self.first.n, self.start.n, self.size.n = places_to, len(kept), len(kept)

    def grow(self, units):
        part, held = [], 0
        for u in units:
            if part and held + len(u) > GROW_CHARS:
                self.add(part)
                part, held = [], 0
            part.append(u)
            held += len(u)
        self.add(part)

    def add(self, units: list[bytes]):
        chars, lengths = characters(units)
        owner = np.repeat(np.arange(len(units)), lengths)
        begin = np.cumsum(lengths) - lengths
        at, length, piece, weight = self.v.arcs(chars, begin[owner] + lengths[owner] - np.arange(len(chars)))
        source = at + owner[at]  # a unit of n characters has n + 1 places
        place = source + length
        n_places = len(chars) + len(units)
        order = np.argsort(place, kind="stable")  # at each place the longest pieces, which are often the likeliest, come first
        source, place, length, piece, weight = source[order], place[order], length[order], piece[order], weight[order]
        arcs = np.bincount(place, minlength=n_places)
        first = np.cumsum(arcs) - arcs
        unit_of = owner[source - owner[at[order]]]
        share = self.shares(source, place, place - (begin + np.arange(len(units)))[unit_of], weight, n_places)
        run = np.cumsum((share * WHOLE).astype(np.int64))
        run -= np.repeat((run - (share * WHOLE).astype(np.int64))[np.minimum(first, len(run) - 1)], arcs)
        run[np.cumsum(arcs)[arcs > 0] - 1] = WHOLE
        self.start.extend(self.first.n + begin + np.arange(len(units)))
        self.size.extend(lengths)
        self.first.extend(self.upto.n + first)
        self.upto.extend(np.minimum(run, WHOLE))
        self.back.extend(length)
        self.piece.extend(piece)

    @staticmethod
    def shares(source, place, far, weight, places) -> np.ndarray:
        """Forward filtering: the share of each arc among all ways to the place where it ends. far: that place's distance from its unit's start."""
        order = np.lexsort((place, far))
        source, place, weight = source[order], place[order], weight[order]
        held, out = np.zeros(places), np.empty(len(order))
        new = np.nonzero(np.diff(place, prepend=-1))[0]
        ends = np.append(np.nonzero(np.diff(far[order]))[0] + 1, len(order))
        a = 0
        for b in ends.tolist():
            lo, hi = np.searchsorted(new, (a, b))
            groups = new[lo:hi] - a
            count = np.diff(np.append(groups, b - a))
            x = held[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(x, groups)
            x = np.exp(x - np.repeat(top, count))
            total = np.add.reduceat(x, groups)
            held[place[a:b][groups]] = top + np.log(total)
            out[a:b] = x / np.repeat(total, count)
            a = b
        back = np.empty(len(order))
        back[order] = out
        return back

    def sample(self, texts: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8) and how many each has. keys: 64-bit hashes of the row keys."""
        units, lengths = units_in(texts)
        if not len(units):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if self.upto.n > ARCS_KEPT:
            self.codes.shrink()
        codes = self.codes(units)
        with np.errstate(over="ignore"):
            salted = np.repeat(keys.astype(np.int64).view(np.uint64) ^ np.uint64(self.seed), lengths)
        place = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)
        upto, back, first = self.upto.all, self.back.all, self.first.all
        start = self.start.all[codes].astype(np.int64)
        at = start + self.size.all[codes]
        live, steps, taken = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        while len(live):
            arc = first[at[live]].astype(np.int64)
            number = drawn(salted[live], place[live], len(taken))
            later = np.nonzero(upto[arc] <= number)[0]
            while len(later):
                arc[later] += 1
                later = later[upto[arc[later]] <= number[later]]
            taken.append((live, arc))
            steps[live] += 1
            at[live] -= back[arc]
            live = live[at[live] > start[live]]
        order = np.empty(int(steps.sum()), np.int64)
        last = np.cumsum(steps) - 1
        for k, (units, arc) in enumerate(taken):
            order[last[units] - k] = arc
        pieces = self.piece.all[order]
        ids, n = self.written(pieces)
        return ids, sums(n, sums(steps, lengths).astype(np.int64)).astype(np.int64)

    def written(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, with characters that have none as their bytes' pieces, and how many ids each has."""
        n = np.ones(len(pieces), np.int64)
        bare = np.nonzero(pieces < 0)[0]
        if not len(bare):
            return pieces, n
        chars = -1 - pieces[bare].astype(np.int64)
        n[bare] = size = utf8_length(chars)
        ids = np.repeat(pieces, n)
        at = spread(np.cumsum(n)[bare] - size, size)
        k = at - np.repeat(np.cumsum(n)[bare] - size, size)
        ids[at] = self.v.byte[utf8_byte(np.repeat(chars, size), np.repeat(size, size), k)]
        return ids, n


def encode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", keep: list | None = None, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Adds ids (array<int>), n_pieces and lossless (the ids decode to the text) to every row.

    Null and empty texts have no ids; a null key is a key like others; rows with the same key and text get the same ids.
    Columns of the new names are replaced; all others, and repeated rows, stay.
    """

    def setup():
        sampler = Sampler(Vocabulary(model_file, alpha), seed)

        def work(texts, keys):
            ids, n = sampler.sample(texts, keys)
            back = sampler.v.decode(ids, n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            return {"ids": lists, "n_pieces": n, "lossless": [b == (t or b"") for b, t in zip(back, texts)]}

        return work

    return map_texts(docs, text, setup, [("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("lossless", T.BooleanType())], keep, key, SAMPLE_BYTES)


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of every row's ids; null ids give a null text, no ids an empty one."""
    stay = [c for c in encoded.columns if c != out]
    schema = T.StructType([encoded.schema[c] for c in stay] + [T.StructField(out, T.StringType())])

    def run(batches):
        v = Vocabulary(model_file)
        for batch in batches:
            lists = batch.column(len(stay)).to_pylist()
            flat = np.array([i for x in lists for i in x or []], np.int64)
            texts = v.decode(flat, np.array([len(x or []) for x in lists], np.int64))
            made = pa.array([None if x is None else t.decode("utf-8", "replace") for x, t in zip(lists, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(stay))), made], names=[*stay, out])

    return encoded.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, schema)
