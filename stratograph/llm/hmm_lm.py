"""Hidden Markov language model over whole texts.

Tokens are lower-cased words, then one end for each text.  Every word of the training texts has emission probabilities
of its own in every state,

    P(word | state) = (g + 1/K) / (G + (V + 1)/K)

with g the word's expected count in the state, G all words' together, V the distinct training words and K the states; the
1 more is for all unknown words together.  States that do not differ give the unigram base.

Blocks: each task cuts its texts into blocks of ``BLOCK_TOKENS`` tokens (a longer text is one block), numbered by the
block's own sorted words.  The words of all blocks are dealt to parts by the leading bits of their hashes, as many parts
as keep one under ``PART_PAIRS`` pairs of a word and a block; a link row of a part says which of its words each block has.

Training (Baum-Welch): a round runs the scaled forward-backward recursion over whole texts.  A text longer than
``SEGMENT`` tokens is cut, and products of matrices along it give each segment the exact forward and backward vectors at
its ends, so that segments run side by side and no transition is lost.  A block's expected counts travel as one array a
part; the part adds them up and sends every block its words' new counts.  What a round moves grows with the vocabulary;
the driver sees the chain's sums alone.  Every training token counts in every round, and rounds go on until the log
likelihood gains less than ``TOLERANCE`` of itself.  They start from a model that the same rounds gave on the
``SAMPLE_TEXTS`` training texts of smallest hash, which only spares rounds.

Scoring: the same forward recursion gives the exact likelihood of texts of any length.

The unigram base beside it: sum of log10((c + 1) / (N + V + 1)), with c the word's count.

Defined results: null and empty texts are the end alone; a null doc_id hashes as no text does, and is training; without
training texts N = V = 0 and every word is unknown; repeated rows count as often as they stand there; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._spark import forget, read_table, small_batches, written

STATES = 4
TOLERANCE = 1e-4
SEGMENT = 2048
#: Forward vectors are scaled at every so many tokens.
RESCALE = 8
SAMPLE_TEXTS = 1_000
SEED = 7
GROUP_BYTES = 2 << 20
BLOCK_TOKENS = 3 << 20
PART_PAIRS = 1 << 19
#: Tokens whose recursions are in memory at once.
RUN_TOKENS = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = A.U(0x9AE16A3B2F90404F)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, each with its end; first token of each text and the total)."""
    words = A.Words(*A.texts_of(column), A.SPACE_WORDS)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(len(words) + n, END, dtype=np.uint64)
    out[np.arange(len(words)) + words.owners()] = words.hashes
    return out, first


# ---- the model


class Model:
    """Start and transition probabilities, and all words' expected counts by state."""

    def __init__(self, start: np.ndarray, step: np.ndarray, total: np.ndarray, words: int):
        self.start, self.step, self.total, self.words = start, step, total, words

    @classmethod
    def first(cls, states: int, total: np.ndarray, words: int) -> Model:
        step = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * (0.7 - 0.3 / max(1, states - 1))
        return cls(np.full(states, 1 / states), step / step.sum(1, keepdims=True), total, words)

    @classmethod
    def of_sums(cls, sums: Sums, words: int) -> Model:
        smooth = lambda x: (x + 0.1) / (x + 0.1).sum(-1, keepdims=True)
        return cls(smooth(sums.start), smooth(sums.step), sums.total, words)

    def emissions(self, g: np.ndarray) -> np.ndarray:
        """P(word | state) for each row of expected counts."""
        k = len(self.start)
        return (g + 1 / k) / (self.total + (self.words + 1) / k)


class Sums:
    """Baum-Welch sums of the chain, and the log likelihood."""

    def __init__(self, states: int):
        self.start, self.step, self.total, self.log = np.zeros(states), np.zeros((states, states)), np.zeros(states), 0.0

    def flat(self) -> list[float]:
        return [self.log, *self.start, *self.total, *self.step.reshape(-1)]

    @classmethod
    def of_flat(cls, values: list[float], states: int) -> Sums:
        out = cls(states)
        out.log, rest = values[0], np.array(values[1:])
        out.start, out.total, out.step = rest[:states], rest[states : 2 * states], rest[2 * states :].reshape(states, states)
        return out


def spread(h: np.ndarray, c: np.ndarray, states: int) -> np.ndarray:
    """First expected counts (words x states): each word's count, dealt to the states at random by its hash."""
    share = np.stack([A.mixed(h + A.U(SEED + 1 + s)) for s in range(states)], axis=1).astype(np.float64) / 2.0**64 * 1.6 + 0.2
    return share / share.sum(1, keepdims=True) * c[:, None]


# ---- recursions over texts


class Segments:
    """The segments of some texts by falling length, with their tokens in order of time: the t-th tokens of all
    segments that have one stand together, from ``at[t]`` on."""

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        count = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = first[:-1][text] + nth * SEGMENT
        length = np.minimum(SEGMENT, first[1:][text] - start)
        order = np.argsort(-length, kind="stable")
        self.text, self.nth, self.start, self.length = text[order], nth[order], start[order], length[order]
        self.opening, self.parts = self.nth == 0, count[self.text]
        longest = int(self.length[0]) if len(order) else 0
        self.active = np.searchsorted(-self.length, -np.arange(longest), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        inside = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.token = self.start[inside] + np.repeat(np.arange(longest), self.active)
        self.owner = self.text[inside]

    def __len__(self) -> int:
        return len(self.text)


def ends(seg: Segments, b: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: the state distribution before its first token, the one at the last token of the segment before,
    and what follows it (up to a factor).  ``b``: emissions over the largest of each token, in order of time."""
    k = len(m.start)
    prior, before, after = np.broadcast_to(m.start, (len(seg), k)).copy(), np.zeros((len(seg), k)), np.ones((len(seg), k))
    cut = np.flatnonzero(seg.parts > 1)
    if not len(cut):
        return prior, before, after
    # cut segments are numbered by falling length as all are
    product = np.empty((len(cut), k, k))
    length = seg.length[cut]
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left").tolist()
    for t, n in enumerate(active):
        here = b[seg.at[t] + cut[:n], None, :]
        if t:
            p = (product[:n].reshape(n * k, k) @ m.step).reshape(n, k, k)
            p *= here
        else:
            p = np.eye(k) * here
        if t % RESCALE == RESCALE - 1:
            p /= p.max(axis=(1, 2), keepdims=True)
        product[:n] = p
    product /= product.max(axis=(1, 2), keepdims=True)
    by_text = np.lexsort((seg.nth[cut], seg.text[cut]))
    own, product = cut[by_text], product[by_text]
    heads = np.flatnonzero(seg.nth[own] == 0)
    count = seg.parts[own[heads]]
    for j in range(1, int(count.max())):
        some = heads[count > j] + j
        alpha = np.einsum("ni,nij->nj", prior[own[some - 1]], product[some - 1])
        before[own[some]] = alpha / alpha.sum(1, keepdims=True)
        prior[own[some]] = before[own[some]] @ m.step
    for j in range(int(count.max()) - 1, 0, -1):
        some = heads[count > j] + j
        beta = np.einsum("nij,nj->ni", product[some], after[own[some]]) @ m.step.T
        after[own[some - 1]] = beta / beta.max(1, keepdims=True)
    return prior, before, after


def emissions_of(seg: Segments, symbols: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols in order of time, their emissions over the largest state's, that one)."""
    named = np.take(symbols, seg.token)
    top = emit.max(1)
    return named, np.take(emit / top[:, None], named, axis=0), np.take(top, named)


def forward(seg: Segments, b: np.ndarray, prior: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors of all tokens in order of time, and the scales they were divided by at every ``RESCALE``-th token
    and at a segment's last (1 at others)."""
    alphas, scales = np.empty_like(b), np.ones(len(b), dtype=b.dtype)
    step = m.step.astype(b.dtype)
    at = seg.at.tolist()
    for t, n in enumerate(seg.active.tolist()):
        a = alphas[at[t] : at[t] + n]
        if t:
            np.matmul(alphas[at[t - 1] : at[t - 1] + n], step, out=a)
        else:
            a[:] = prior
        a *= b[at[t] : at[t] + n]
        if t % RESCALE == RESCALE - 1:
            c = a.sum(1)
            a /= c[:, None]
            scales[at[t] : at[t] + n] = c
    last = seg.at[seg.length - 1] + np.arange(len(seg))
    c = alphas[last].sum(1)
    alphas[last] /= c[:, None]
    scales[last] *= c
    return alphas, scales


def expected_counts(symbols: np.ndarray, first: np.ndarray, emit: np.ndarray, m: Model, sums: Sums, emits: np.ndarray) -> None:
    """Add the Baum-Welch sums of whole texts to ``sums`` and, by symbol, to ``emits``."""
    seg = Segments(first)
    named, b, top = emissions_of(seg, symbols, emit)
    prior, before, after = ends(seg, b, m)
    alphas, scales = forward(seg, b, prior, m)
    scaled = scales != 1
    sums.log += float(np.log(top.astype(np.float64)).sum() + np.log(scales[scaled].astype(np.float64)).sum())
    b /= scales[:, None]
    back = np.ascontiguousarray(m.step.T.astype(b.dtype))
    last = seg.at[seg.length - 1] + np.arange(len(seg))
    betas = np.empty_like(b)
    betas[last] = after / (alphas[last] * after).sum(1, keepdims=True)
    at = seg.at.tolist()
    for t in range(len(at) - 2, 0, -1):
        n = at[t + 1] - at[t]
        onward = b[at[t] : at[t + 1]]  # emissions become emissions times what follows
        onward *= betas[at[t] : at[t + 1]]
        np.matmul(onward, back, out=betas[at[t - 1] : at[t - 1] + n])
    begin = at[1] if len(at) > 1 else 0
    b[:begin] *= betas[:begin]
    steps = np.zeros((len(m.start),) * 2)
    previous = np.arange(begin, len(b)) - np.repeat(seg.active[:-1], seg.active[1:])
    for x in range(0, len(previous), 1 << 16):
        steps += np.take(alphas, previous[x : x + (1 << 16)], axis=0).T @ b[begin + x : begin + x + (1 << 16)]
    later = np.flatnonzero(~seg.opening)
    steps += before[later].T @ b[later]
    sums.step += steps * m.step
    alphas *= betas  # the state probabilities of every token
    sums.start += alphas[np.flatnonzero(seg.opening)].sum(0)
    for s in range(emits.shape[1]):
        emits[:, s] += np.bincount(named, weights=alphas[:, s], minlength=len(emits))


def log_likelihoods(symbols: np.ndarray, first: np.ndarray, emit: np.ndarray, m: Model) -> np.ndarray:
    """log10 of the model's probability of each whole text."""
    seg = Segments(first)
    _, b, top = emissions_of(seg, symbols, emit)
    scales = forward(seg, b, ends(seg, b, m)[0], m)[1]
    return np.bincount(seg.owner, weights=np.log10(scales) + np.log10(top), minlength=len(first) - 1)


def runs(first: np.ndarray, most: int = RUN_TOKENS):
    """Ranges of texts with at most so many tokens; a longer text is alone."""
    a, n = 0, len(first) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1)
        yield a, z
        a = z


# ---- blocks and parts


def _blocks(block_tokens: int):
    """Rows of text as blocks; training and held-out texts are in blocks of their own."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        open_ = {False: ([], [], []), True: ([], [], [])}

        def block(held: bool):
            nonlocal made
            ids, lengths, hashes = open_[held]
            open_[held] = ([], [], [])
            words, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            lengths = np.concatenate(lengths)
            made += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + made]),
                    pa.array([held]),
                    A.lists(pa.concat_arrays(ids), np.array([len(lengths)])),
                    pa.array([lengths.astype(np.int32).tobytes()]),
                    pa.array([planes(place)]),
                    pa.array([words.tobytes()]),
                    pa.array([count.astype(np.int32).tobytes()]),
                    pa.array([len(place)]),
                    pa.array([len(words)]),
                ],
                names=["block", "held_out", "ids", "lengths", "tokens", "words", "counts", "n_tokens", "n_words"],
            )

        for part in A.grouped(batches, "text", GROUP_BYTES):
            for held in (False, True):
                own = part.filter(pc.equal(part.column("held_out"), held)).combine_chunks()
                if not own.num_rows:
                    continue
                h, first = tokens_of(own.column("text"))
                ids, lengths, hashes = open_[held]
                ids.append(own.column("doc_id").combine_chunks())
                lengths.append(np.diff(first))
                hashes.append(h)
                if sum(map(len, hashes)) >= block_tokens:
                    yield block(held)
        for held in (False, True):
            if open_[held][0]:
                yield block(held)

    return run


def planes(numbers: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all lowest ones first: the high ones are alike, and tables and shuffles pack them."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<i4").reshape(-1)


def part_edges(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts that sorted words fall into, where each begins, and the end)."""
    if not bits:
        return np.zeros(min(1, len(words)), dtype=np.int64), np.array([0, len(words)])
    parts, begin = np.unique((words >> A.U(64 - bits)).astype(np.int64), return_index=True)
    return parts, np.append(begin, len(words))



def _dealt(bits: int):
    """Of each block, its words by part."""

    def run(batches):
        for batch in batches:
            for block, held, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "held_out", "words", "counts"))):
                words, counts = np.frombuffer(words, dtype=np.uint64), np.frombuffer(counts, dtype=np.int32)
                parts, at = part_edges(words, bits)
                cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts.astype(np.int32)),
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([held] * len(parts), pa.bool_()),
                        pa.array([words[a:z].tobytes() for a, z in cuts], pa.binary()),
                        pa.array([counts[a:z].tobytes() for a, z in cuts], pa.binary()),
                    ],
                    names=["part", "block", "held_out", "words", "counts"],
                )

    return run


LINKS = "part int, n long, blocks array<long>, held array<boolean>, sizes array<int>, places binary, counts binary"


def _link(group: pa.Table) -> pa.Table:
    """One row for a part: its training words' counts, and of each block the places of its words (-1: not in training)."""
    held = np.array(group.column("held_out").to_pylist(), dtype=bool)
    words = [np.frombuffer(w, dtype=np.uint64) for w in group.column("words").to_pylist()]
    counts = [np.frombuffer(c, dtype=np.int32) for c in group.column("counts").to_pylist()]
    known = np.concatenate([np.zeros(0, np.uint64), *(w for w, h in zip(words, held) if not h)])
    vocabulary, which = np.unique(known, return_inverse=True)
    count = np.bincount(which, weights=np.concatenate([np.zeros(0, np.int32), *(c for c, h in zip(counts, held) if not h)]), minlength=len(vocabulary))
    places = []
    for w in words:
        at = np.searchsorted(vocabulary, w)
        at[at == len(vocabulary)] = 0
        places.append(np.where(vocabulary[at] == w, at, -1) if len(vocabulary) else np.full(len(w), -1))
    return pa.table(
        {
            "part": group.column("part").slice(0, 1),
            "n": pa.array([len(vocabulary)], pa.int64()),
            "blocks": pa.array([group.column("block").to_pylist()], pa.list_(pa.int64())),
            "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
            "sizes": pa.array([[len(w) for w in words]], pa.list_(pa.int32())),
            "places": pa.array([np.concatenate(places).astype(np.int32).tobytes()], pa.binary()),
            "counts": pa.array([np.rint(count).astype(np.int64).tobytes()], pa.binary()),
        }
    )


def _adder(states: int, last: bool):
    """A part adds up its words' expected counts and sends them to its blocks, in the last round with their counts."""

    def run(link: pa.Table, sums: pa.Table) -> pa.Table:
        row = {c: link.column(c)[0].as_py() for c in link.column_names}
        places, size = np.frombuffer(row["places"], dtype=np.int32), np.array(row["sizes"])
        end = np.cumsum(size)
        of = {b: places[z - n : z] for b, n, z in zip(row["blocks"], size.tolist(), end.tolist())}
        total = np.zeros((row["n"] + 1, states))
        for block, data in zip(sums.column("block").to_pylist(), sums.column("sums").to_pylist()):
            total[of[block]] += np.frombuffer(data, dtype=np.float32).reshape(-1, states)
        total[-1] = 0.0  # place -1: a word that training has not
        total = total.astype(np.float32)
        counts = np.append(np.frombuffer(row["counts"], dtype=np.int64), 0)
        return pa.table(
            {
                "block": pa.array(row["blocks"], pa.int64()),
                "part": pa.array([row["part"]] * len(size), pa.int32()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "g": pa.array([total[of[b]].tobytes() for b in row["blocks"]], pa.binary()),
                "c": pa.array([counts[of[b]].tobytes() if last else None for b in row["blocks"]], pa.binary()),
            }
        )

    return run


STATE = "block long, part int, held_out boolean, g binary, c binary"
ROUND = "part int, block long, sums binary, chain array<double>"


class Block:
    def __init__(self, row: pa.Table):
        raw = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), dtype=kind)
        self.id, self.ids = row.column("block")[0].as_py(), row.column("ids").combine_chunks().flatten()
        self.held = row.column("held_out")[0].as_py()
        self.tokens, self.words = from_planes(raw("tokens", np.uint8)), raw("words", np.uint64)
        self.first = np.concatenate([[0], np.cumsum(raw("lengths", np.int32), dtype=np.int64)])


def joined(state: pa.Table, column: str, kind) -> np.ndarray:
    """A block's values of all parts, in order of its words."""
    state = state.sort_by("part")
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, dtype=kind) for x in state.column(column).to_pylist())])


def _round(shared, bits: int, start: bool):
    """Expected counts of a block: a row for each part, and one with the chain's sums."""

    def run(block: pa.Table, state: pa.Table) -> pa.Table:
        m, known, first_g = shared.value
        k = len(m.start)
        own = Block(block)
        if start:
            g = np.zeros((len(own.words), k))
            at = np.minimum(np.searchsorted(known, own.words), max(0, len(known) - 1))
            if len(known):
                hit = known[at] == own.words
                g[hit] = first_g[at[hit]]
        else:
            g = joined(state, "g", np.float32).reshape(-1, k)
        emit = m.emissions(g).astype(np.float32)
        sums, emits = Sums(k), np.zeros((len(own.words), k))
        for a, z in runs(own.first):
            base = own.first[a]
            expected_counts(own.tokens[base : own.first[z]], own.first[a : z + 1] - base, emit, m, sums, emits)
        sums.total = emits.sum(0)
        parts, at = part_edges(own.words, bits)
        data = [emits[x:y].astype(np.float32).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        A.give_back()
        return pa.table(
            {
                "part": pa.array([*parts.tolist(), -1], pa.int32()),
                "block": pa.array([own.id] * (len(parts) + 1), pa.int64()),
                "sums": pa.array([*data, None], pa.binary()),
                "chain": pa.array([*[None] * len(parts), sums.flat()], pa.list_(pa.float64())),
            }
        )

    return run


def _sampled(states: int, tolerance: float):
    """One model from the rows of a sample: start, step, total, words and their expected counts, as bytes."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        h, first = tokens_of(table.column("text"))
        words, symbols, count = np.unique(h, return_inverse=True, return_counts=True)
        g = spread(words, count, states)
        m, before = Model.first(states, g.sum(0), len(words)), -np.inf
        while True:
            sums, emits = Sums(states), np.zeros((len(words), states))
            emit = m.emissions(g).astype(np.float32)
            for a, z in runs(first):
                expected_counts(symbols[first[a] : first[z]], first[a : z + 1] - first[a], emit, m, sums, emits)
            sums.total, g = emits.sum(0), emits
            m = Model.of_sums(sums, len(words))
            if sums.log - before <= tolerance * abs(sums.log):
                break
            before = sums.log
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.astype(np.float64).tobytes()]) for x in (m.start, m.step, m.total, g)] + [pa.array([words.tobytes()])],
            names=["start", "step", "total", "g", "words"],
        )

    return run


def first_model(training: DataFrame, states: int, tolerance: float) -> tuple[Model, np.ndarray, np.ndarray]:
    """(model, known words, their expected counts) of the sample."""
    sample = training.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(SAMPLE_TEXTS).select("text").coalesce(1)
    row = sample.mapInArrow(_sampled(states, tolerance), "start binary, step binary, total binary, g binary, words binary").first()
    read = lambda c: np.frombuffer(row[c], dtype=np.float64)
    words = np.frombuffer(row["words"], dtype=np.uint64)
    return Model(read("start"), read("step").reshape(states, states), read("total"), len(words)), words, read("g").reshape(-1, states).astype(np.float32)


def baum_welch(blocks: DataFrame, links: DataFrame, first, words: int, bits: int, tolerance: float) -> tuple[DataFrame, Model]:
    """(the words' expected counts by block and part, the model) once a round gains less than ``tolerance``."""
    spark = blocks.sparkSession
    training = blocks.where("not held_out").drop("counts")
    known, before, m = None, -np.inf, first[0]
    states = len(m.start)
    empty = spark.createDataFrame([], STATE)
    while True:
        start = known is None
        shared = spark.sparkContext.broadcast((m, first[1], first[2]) if start else (m, None, None))
        own = empty if start else known.where("not held_out")
        got = training.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_round(shared, bits, start), ROUND)
        got = written(got, "expected-counts")
        chain = got.where("chain is not null").select(F.posexplode("chain")).groupBy("pos").agg(F.sum("col").alias("x")).orderBy("pos").collect()
        sums = Sums.of_flat([r["x"] for r in chain], states)
        m = Model.of_sums(sums, words)
        last = sums.log - before <= tolerance * abs(sums.log)
        before = sums.log
        new = written(added(links, got.where("part >= 0"), states, last), "word-states")
        shared.destroy()
        for old in (got, known):
            if old is not None:
                forget(old)
        known = new
        if last:
            return known, m


def added(links: DataFrame, sums: DataFrame, states: int, last: bool) -> DataFrame:
    return links.groupBy("part").cogroup(sums.select("part", "block", "sums").groupBy("part")).applyInArrow(_adder(states, last), STATE)


def _score(shared):
    def run(block: pa.Table, state: pa.Table) -> pa.Table:
        m, tokens, words = shared.value
        own = Block(block)
        counts = joined(state, "c", np.int64)
        emit = m.emissions(joined(state, "g", np.float32).reshape(-1, len(m.start)))
        texts = len(own.ids)
        who = np.repeat(np.arange(texts), np.diff(own.first))
        base = np.bincount(who, weights=np.log10((counts + 1.0) / (tokens + words + 1.0))[own.tokens], minlength=texts)
        known = np.bincount(who[counts[own.tokens] > 0], minlength=texts)
        scores = [
            log_likelihoods(own.tokens[own.first[a] : own.first[z]], own.first[a : z + 1] - own.first[a], emit, m)
            for a, z in runs(own.first, RUN_TOKENS // 2)
        ]
        A.give_back()
        return pa.table(
            {
                "doc_id": own.ids,
                "held_out": pa.array(np.full(texts, own.held)),
                "n_tokens": np.diff(own.first),
                "n_known": known,
                "train_tokens": np.full(texts, tokens),
                "base_score": base,
                "score": np.concatenate(scores),
            }
        )

    return run


def language_model_scores(
    docs: DataFrame, states: int = STATES, tolerance: float = TOLERANCE, block_tokens: int = BLOCK_TOKENS, part_pairs: int = PART_PAIRS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = written(
        docs.mapInArrow(
            _blocks(block_tokens),
            f"block long, held_out boolean, ids array<{kind}>, lengths binary, tokens binary, words binary, counts binary, n_tokens long, n_words long",
        ),
        "token-blocks",
    )
    pairs, tokens = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0))).first()
    bits = max(0, (-(-pairs // part_pairs) - 1).bit_length())
    dealt = blocks.select("block", "held_out", "words", "counts").mapInArrow(
        _dealt(bits), "part int, block long, held_out boolean, words binary, counts binary"
    )
    links = written(dealt.groupBy("part").applyInArrow(_link, LINKS), "word-links")
    words = links.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # a round's shuffle files go when it ends
    try:
        if tokens:
            known, m = baum_welch(blocks, links, first_model(docs.where("not held_out"), states, tolerance), words, bits, tolerance)
        else:
            m = Model.first(states, np.zeros(states), 0)
            known = written(added(links, spark.createDataFrame([], ROUND), states, True), "word-states")
    finally:
        spark.conf.set(CLEANUP, cleanup)
    scored = blocks.drop("counts").groupBy("block").cogroup(known.groupBy("block"))
    return scored.applyInArrow(
        _score(spark.sparkContext.broadcast((m, tokens, words))),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op4_hmm_language_model(spark, sf_dir):
    return language_model_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
