"""The sequential core: contexts as principal-component models, learnt in one pass over an ordered stream.

Pure numpy, no Spark. A row is scored against the models; one that no model accepts goes to a buffer, and a full buffer
becomes a new model. What happens to a buffer that doesn't fill, to memories and to labels is a matter of Params, so that
each published variant can be had. A model's score of x is |(x - centroid) A| with A the retained components, each times
the square root of its variance (or divided by it, score="mahalanobis").
"""

from __future__ import annotations

import pickle
from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np


#: Up to so many features, models are scored together.
NARROW = 16


@dataclass(frozen=True)
class Params:
    """drift_threshold: largest acceptable score. drift_size: outliers that make a model (v2: length of the window).

    partial_memory_to, partial_label_to: whose memory and label a buffer gets that didn't fill: the model that accepted
    the next row ("best") or the one before ("current"). end_buffer: "current", or "model" for a model of its own.
    merge: what happens at model_limit: "interleave" joins the stalest model with its nearest neighbour, "alternate"
    builds the new model from its rows and the stalest model's. deferred: models change only at refresh()."""

    drift_threshold: float
    drift_size: int
    p_var: float = 0.98
    model_mem: int = 500
    model_limit: int | None = None
    init_size: int | None = None
    algorithm: str = "v1"
    partial_memory_to: str = "best"
    partial_label_to: str = "current"
    end_buffer: str = "current"
    model_backend: str = "batch_pca"
    score: str = "variance_weighted"
    merge: str = "interleave"
    deferred: bool = False

    def __post_init__(self):
        for name, allowed in (("algorithm", ("v1", "v2")), ("partial_memory_to", ("best", "current")), ("partial_label_to", ("best", "current")), ("end_buffer", ("current", "model")), ("model_backend", ("batch_pca", "incremental")), ("score", ("variance_weighted", "mahalanobis")), ("merge", ("interleave", "alternate"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.drift_size < 1 or self.model_mem < 1 or not 0 < self.p_var <= 1:
            raise ValueError("drift_size and model_mem must be at least 1, p_var above 0 and at most 1")
        if self.model_limit is not None and self.model_limit < 2:
            raise ValueError("model_limit must be at least 2: merging needs a neighbour")

    @property
    def first_rows(self) -> int:
        """Rows of the first model."""
        if self.init_size is None:
            return self.drift_size
        return max(1, min(self.init_size, self.model_mem))


def component_count(variances: np.ndarray, p_var: float) -> int:
    """The first k of the falling variances whose share reaches p_var; all where p_var is 1 or nothing varies."""
    total = variances.sum()
    if p_var >= 1 or total <= 0:
        return len(variances)
    reached = np.flatnonzero(np.cumsum(variances) / total >= p_var)
    return int(reached[0]) + 1 if len(reached) else len(variances)


def decompose(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variances falling, components as columns) of a covariance matrix; variances below zero are rounding and become 0."""
    v, c = np.linalg.eigh(cov)
    return np.maximum(v[::-1], 0), c[:, ::-1]


def transform(variances: np.ndarray, components: np.ndarray, k: int, score: str) -> np.ndarray:
    d = np.sqrt(variances[:k])
    if score == "mahalanobis":
        d = np.where(d > 1e-12, 1 / np.maximum(d, 1e-12), 0)
    return components[:, :k] * d


class Model:
    """A context with a memory of its latest rows. Sums of rows and products follow the memory, so a refit costs one
    decomposition; they are taken anew now and then to keep rounding small."""

    REFRESH = 256

    def __init__(self, model_id: int, rows: list[tuple[int, np.ndarray]], seq: int, p: Params):
        self.id, self.p, self.last, self.version = model_id, p, seq, 0
        self.memory: deque[tuple[int, np.ndarray]] = deque(rows)
        self.pending: list[tuple[int, np.ndarray]] = []
        self._restart()
        self._fit()

    def _restart(self) -> None:
        x = np.array([r for _, r in self.memory])
        self.origin = x.mean(0)
        d = x - self.origin
        self.sum, self.square, self.age = d.sum(0), d.T @ d, 0

    def _fit(self) -> None:
        m = len(self.memory)
        mean = self.sum / m
        cov = (self.square - m * np.outer(mean, mean)) / (m - 1) if m > 1 else np.zeros_like(self.square)
        self.centroid = self.origin + mean
        self.variances, c = decompose(cov)
        self.n_pcs = component_count(self.variances, self.p.p_var)
        self.coeff = transform(self.variances, c, self.n_pcs, self.p.score)

    def absorb(self, rows: list[tuple[int, np.ndarray]], seq: int) -> None:
        self.version += 1
        if self.p.deferred:
            self.pending += rows
            self.last = seq
            return
        for r in rows:
            d = r[1] - self.origin
            self.memory.append(r)
            self.sum, self.square = self.sum + d, self.square + np.outer(d, d)
            if len(self.memory) > self.p.model_mem:
                d = self.memory.popleft()[1] - self.origin
                self.sum, self.square = self.sum - d, self.square - np.outer(d, d)
            self.age += 1
        while len(self.memory) > self.p.model_mem:  # a first model may be larger than the memory
            d = self.memory.popleft()[1] - self.origin
            self.sum, self.square = self.sum - d, self.square - np.outer(d, d)
        if self.age >= self.REFRESH:
            self._restart()
        self.last = seq
        self._fit()

    def refresh(self) -> None:
        if self.pending:
            self.version += 1
            for r in self.pending:
                self.memory.append(r)
            while len(self.memory) > self.p.model_mem:
                self.memory.popleft()
            self.pending = []
            self._restart()
            self._fit()

    def score(self, x: np.ndarray) -> float:
        y = (x - self.centroid) @ self.coeff
        return float(np.sqrt(y @ y))

    def rows(self) -> list[tuple[int, np.ndarray]]:
        return list(self.memory)


class IncrementalModel:
    """A context without memory: mean, basis and singular values, updated exactly for each row (Brand 2006; Ross et al.
    2008). Directions past the retained ones and one more are dropped; with p_var 1 nothing is."""

    def __init__(self, model_id: int, rows: list[tuple[int, np.ndarray]], seq: int, p: Params):
        self.id, self.p, self.last, self.version = model_id, p, seq, 0
        x = np.array([r for _, r in rows])
        self.count, self.centroid = len(x), x.mean(0)
        self.pending: list[tuple[int, np.ndarray]] = []
        u, s, _ = np.linalg.svd((x - self.centroid).T, full_matrices=False)
        self.mass = float((s**2).sum())
        self.u, self.s = u[:, s > 1e-12 * max(1.0, s.max(initial=0))], s[s > 1e-12 * max(1.0, s.max(initial=0))]
        self._cut()

    def _cut(self) -> None:
        share = np.cumsum(self.s**2) / self.mass if self.mass > 0 else np.ones(len(self.s))
        over = np.flatnonzero(share > self.p.p_var) if self.p.p_var < 1 else []  # strictly more; all where none reaches it
        self.n_pcs = max(1, int(over[0]) + 1 if len(over) else len(self.s))
        keep = len(self.s) if self.p.p_var >= 1 else self.n_pcs + 1
        self.u, self.s = self.u[:, :keep], self.s[:keep]
        self.variances = self.s**2 / max(1, self.count - 1)
        self.coeff = transform(self.variances, self.u, self.n_pcs, self.p.score)

    def _one(self, x: np.ndarray) -> None:
        b = np.sqrt(self.count / (self.count + 1)) * (x - self.centroid)
        self.centroid = self.centroid + (x - self.centroid) / (self.count + 1)
        self.count += 1
        self.mass += float(b @ b)
        m = self.u.T @ b
        rest = b - self.u @ m
        rest -= self.u @ (self.u.T @ rest)
        r, k = float(np.linalg.norm(rest)), len(self.s)
        new = r > 1e-10 * max(1.0, float(np.linalg.norm(b))) and k < len(x)
        q = np.zeros((k + new, k + 1))
        q[:k, :k], q[:k, k] = np.diag(self.s), m
        base = self.u
        if new:
            q[k, k] = r
            base = np.column_stack([self.u, rest / r])
        a, s, _ = np.linalg.svd(q, full_matrices=False)
        self.u, self.s = base @ a, s

    def absorb(self, rows: list[tuple[int, np.ndarray]], seq: int) -> None:
        self.last, self.version = seq, self.version + 1
        if self.p.deferred:
            self.pending += rows
            return
        for _, x in rows:
            self._one(x)
            self._cut()

    def refresh(self) -> None:
        self.version += bool(self.pending)
        for _, x in self.pending:
            self._one(x)
            self._cut()
        self.pending = []

    def join(self, other: IncrementalModel) -> None:
        """Take over another model's rows: the two scatter matrices and the distance of the means add up."""
        self.version += 1
        n, d = self.count + other.count, self.centroid - other.centroid
        gap = np.sqrt(self.count * other.count / n) * d
        u, s, _ = np.linalg.svd(np.column_stack([self.u * self.s, other.u * other.s, gap]), full_matrices=False)
        self.mass += other.mass + float(gap @ gap)
        self.centroid, self.count = (self.count * self.centroid + other.count * other.centroid) / n, n
        keep = s > 1e-12 * max(1.0, s.max(initial=0))
        self.u, self.s = u[:, keep], s[keep]
        self._cut()

    score = Model.score

    def rows(self) -> list[tuple[int, np.ndarray]]:
        return []


Label = tuple[int, int | None, float | None, bool | None]  # seq, context, score when scored, outlier; nulls for a late row


@dataclass
class Kernel:
    """init: Kernel(params). offer (or step): feed rows in order. close: end of the stream. Each returns the labels resolved by then."""

    params: Params
    models: dict[int, Model | IncrementalModel] = field(default_factory=dict)
    current: int = 0
    next_id: int = 1
    last_seq: int | None = None
    waiting: list[tuple[int, np.ndarray]] = field(default_factory=list)  # rows of the first model
    buffer: deque = field(default_factory=deque)  # v1: (seq, row, score); v2: (seq, row, score, model)
    transitions: dict[tuple[int, int], int] = field(default_factory=lambda: defaultdict(int))
    closed: bool = False
    _stack: tuple | None = None  # what _scores keeps of the models

    def _make(self, rows: list[tuple[int, np.ndarray]], seq: int) -> int:
        kind = IncrementalModel if self.params.model_backend == "incremental" else Model
        i, self.next_id = self.next_id, self.next_id + 1
        self.models[i] = kind(i, rows, seq, self.params)
        return i

    def _scores(self, x: np.ndarray) -> tuple[int, float]:
        """The least score's model; of equal scores the least id."""
        if len(x) > NARROW or len(self.models) == 1:
            return min(((m.score(x), i) for i, m in self.models.items()))[::-1]
        # Many models of few features: one product over all, whose rows follow the models' versions.
        ids = sorted(self.models)
        if self._stack is None or self._stack[0] != ids:
            self._stack = (ids, [None] * len(ids), np.zeros((len(ids), len(x))), np.zeros((len(ids), len(x), len(x))))
        _, seen, mu, form = self._stack
        for k, i in enumerate(ids):
            m = self.models[i]
            if seen[k] is not m.coeff:
                seen[k], mu[k], form[k] = m.coeff, m.centroid, m.coeff @ m.coeff.T
        d = x - mu
        square = np.einsum("ki,kij,kj->k", d, form, d)
        k = int(square.argmin())
        return ids[k], float(np.sqrt(max(square[k], 0.0)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_stack": None}

    def _start(self) -> list[Label]:
        rows, self.waiting = self.waiting, []
        self.current = self._make(rows, rows[-1][0])
        self.transitions[self.current, self.current] += len(rows)
        self._labelled = self.current
        return [(s, self.current, None, False) for s, _ in rows]

    def offer(self, seq: int, x: np.ndarray) -> list[Label]:
        """step(), but a row that is late, one that doesn't come after the last, is put out with a null context and teaches
        nothing. After close() every row is late."""
        if self.closed or self.last_seq is not None and seq <= self.last_seq:
            return [(seq, None, None, None)]
        return self.step(seq, x)

    def step(self, seq: int, x: np.ndarray) -> list[Label]:
        if self.last_seq is not None and seq <= self.last_seq:
            raise ValueError(f"seq {seq} does not come after {self.last_seq}")
        self.last_seq = seq
        if not self.models:
            self.waiting.append((seq, x))
            return self._start() if len(self.waiting) == self.params.first_rows else []
        return self._v2(seq, x) if self.params.algorithm == "v2" else self._v1(seq, x)

    def _v1(self, seq: int, x: np.ndarray) -> list[Label]:
        p = self.params
        best, score = self._scores(x)
        if score > p.drift_threshold:
            self.buffer.append((seq, x, score))
            return self._born(seq) if len(self.buffer) >= p.drift_size and self._varied() else []
        held = [(s, r) for s, r, _ in self.buffer]
        out = []
        if held:
            to = best if p.partial_label_to == "best" else self.current
            out = [(s, to, v, True) for s, _, v in self.buffer]
            self._moved(to, len(held))
            if p.partial_memory_to == "current":
                self.models[self.current].absorb(held, seq)
                held = []
            self.buffer.clear()
            self.current = to
        self.models[best].absorb([*held, (seq, x)], seq)
        self._moved(best, 1)
        self.current = best
        return [*out, (seq, best, score, False)]

    def _varied(self) -> bool:
        """Whether the buffer can be an incremental model: its rows spread in more than one direction. Until then it grows."""
        if self.params.model_backend != "incremental":
            return True
        x = np.array([r for _, r, *_ in self.buffer])
        return x.shape[1] == 1 or np.linalg.matrix_rank(x - x.mean(0)) > 1

    def _moved(self, to: int, n: int) -> None:
        """n rows in a row get label `to`."""
        self.transitions[self.current, to] += 1
        self.transitions[to, to] += n - 1

    def _born(self, seq: int) -> list[Label]:
        p, rows = self.params, [(s, r) for s, r, *_ in self.buffer]
        out = list(self.buffer)
        self.buffer.clear()
        stale = None
        if p.model_limit is not None and len(self.models) >= p.model_limit:
            stale = min(self.models.values(), key=lambda m: (m.last, m.id))
            if p.merge == "interleave" or not stale.rows():
                self._merge(stale)
            else:
                rows = sorted(alternate(rows, stale.rows()), key=lambda r: r[0])
                del self.models[stale.id]
        new = self._make(rows, seq)
        if stale is not None and p.merge == "alternate" and stale.id in {k for e in self.transitions for k in e}:
            self._rename(stale.id, new)
        self._moved(new, len(out))
        self.current = new
        return [(s, new, v, True) for s, _, v, *_ in out]

    def _merge(self, stale: Model | IncrementalModel) -> None:
        """Join the stalest model with its nearest neighbour, which keeps its id and time."""
        near = min((m for m in self.models.values() if m is not stale), key=lambda m: (float(np.linalg.norm(m.centroid - stale.centroid)), m.id))
        stale.refresh()
        near.refresh()
        if stale.rows():
            rows = alternate(near.rows(), stale.rows(), len(near.rows()) + len(stale.rows()))[: self.params.model_mem]
            merged = Model(near.id, sorted(rows, key=lambda r: r[0]), near.last, self.params)
            merged.version = near.version + 1
            self.models[near.id] = merged
        else:
            near.join(stale)
        del self.models[stale.id]
        self._rename(stale.id, near.id)

    def _rename(self, old: int, new: int) -> None:
        """Transitions of `old` count as those of `new`."""
        moved: dict[tuple[int, int], int] = defaultdict(int)
        for (i, j), n in self.transitions.items():
            moved[new if i == old else i, new if j == old else j] += n
        self.transitions = moved
        self.current = new if self.current == old else self.current
        self._labelled = new if self._labelled == old else self._labelled
        self.buffer = deque((*b[:3], new if b[3] == old else b[3]) if len(b) > 3 else b for b in self.buffer)

    def _v2(self, seq: int, x: np.ndarray) -> list[Label]:
        p, out = self.params, []
        score = self.models[self.current].score(x)
        if score > p.drift_threshold:
            self.current, score = self._scores(x)
        self.buffer.append((seq, x, score, self.current))
        if len(self.buffer) > p.drift_size:
            out.append(self._pop(seq))
        if len(self.buffer) == p.drift_size:
            far = [b[2] > p.drift_threshold for b in self.buffer]
            if far[0] and far[-1] and sum(far) > p.drift_size / 2:
                before = self._labelled
                if before is not None:
                    self.current = before
                out += self._born(seq)
                self._labelled = self.current
        return out

    _labelled: int | None = None  # v2: the label emitted last

    def _pop(self, seq: int) -> Label:
        s, x, v, to = self.buffer.popleft()
        self.models[to].absorb([(s, x)], seq)
        self.transitions[self._labelled, to] += 1
        self._labelled = to
        return (s, to, v, v > self.params.drift_threshold)

    def close(self) -> list[Label]:
        if self.closed:
            return []
        self.closed = True
        if not self.models:
            return self._start() if self.waiting else []
        if self.params.algorithm == "v2":
            return [self._pop(self.last_seq) for _ in range(len(self.buffer))]
        if not self.buffer:
            return []
        if self.params.end_buffer == "model":
            return self._born(self.last_seq)
        rows, out = [(s, r) for s, r, _ in self.buffer], [(s, self.current, v, True) for s, _, v in self.buffer]
        self._moved(self.current, len(rows))
        self.models[self.current].absorb(rows, self.last_seq)
        self.buffer.clear()
        return out

    def refresh(self) -> None:
        """Let models learn the rows that they were given since the last refresh (params.deferred)."""
        for m in self.models.values():
            m.refresh()

    def dump(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def load(data: bytes) -> Kernel:
        return pickle.loads(data)


def alternate(first: list, second: list, length: int | None = None) -> list:
    """Rows in turn, the latest of each first, to `length` rows (default: as many as first has)."""
    a, b, out = list(first)[::-1], list(second)[::-1], []
    for k in range(max(len(a), len(b))):
        out += [*a[k : k + 1], *b[k : k + 1]]
    return out[: len(first) if length is None else length]
