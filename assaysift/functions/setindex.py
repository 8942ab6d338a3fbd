"""Overlap counts between a batch of integer sets and a fixed collection of sets, vectorised for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Upper bound on the counters held at once, and on the postings expanded at once.
CELLS = 1 << 20
# Cells of a collection's 0/1 matrix at most, and the rows of a product times its columns, which stay in a core's cache.
DENSE_CELLS = 1 << 24
SLAB_CELLS = 1 << 17
# Multiplications of a matrix product that cost what counting one posting does.
PER_POSTING = 100


class SetIndex:
    """Postings of a collection: for each element, which sets hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        elements = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
        order = np.argsort(elements, kind="stable")
        self.postings = owners[order]
        self.vocabulary, starts = np.unique(elements[order], return_index=True)
        self.starts = np.append(starts, len(elements)).astype(np.int64)
        self.matrix = None
        if len(sets) and 0 < len(self.vocabulary) * len(sets) <= DENSE_CELLS:
            # Postings expected per pair of sets, against one multiplication per element of the vocabulary.
            shared = float(((np.diff(self.starts) / len(sets)) ** 2).sum())
            if len(self.vocabulary) <= PER_POSTING * shared:
                self.matrix = np.zeros((len(self.vocabulary), len(sets)), dtype=np.float32)
                np.add.at(self.matrix, (np.repeat(np.arange(len(self.vocabulary)), np.diff(self.starts)), self.postings), 1)

    def __len__(self) -> int:
        return len(self.sizes)

    def overlaps(self, batch: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Yield, for slices of the batch, the overlap matrix with the collection and the batch set sizes.

        Where the sets share few distinct elements many times, the counts are products of 0/1 matrices, in single precision,
        which is exact below 2^24; otherwise postings are counted.
        """
        if self.matrix is not None:
            yield from self._products(batch)
            return
        rows = max(1, CELLS // max(1, len(self)))
        for at in range(0, len(batch), rows):
            part = batch[at : at + rows]
            sizes = np.array([len(s) for s in part], dtype=np.int64)
            counts = np.zeros(len(part) * len(self), dtype=np.int64)
            if sizes.sum() and len(self.vocabulary):
                elements = np.concatenate(part)
                owners = np.repeat(np.arange(len(part)), sizes)
                found = np.searchsorted(self.vocabulary, elements)
                found[found == len(self.vocabulary)] = 0
                known = self.vocabulary[found] == elements
                found, owners = found[known], owners[known]
                lengths = self.starts[found + 1] - self.starts[found]
                # Expand the postings of a bounded number of elements at a time.
                cuts = np.searchsorted(np.cumsum(lengths), np.arange(CELLS, lengths.sum() + CELLS, CELLS))
                begin = 0
                for end in [*(cuts + 1), len(found)]:
                    end = min(int(end), len(found))
                    if end <= begin:
                        continue
                    spans = lengths[begin:end]
                    total = int(spans.sum())
                    offsets = np.arange(total) - np.repeat(np.cumsum(spans) - spans, spans)
                    labels = self.postings[np.repeat(self.starts[found[begin:end]], spans) + offsets]
                    cells = np.repeat(owners[begin:end], spans) * len(self) + labels
                    counts += np.bincount(cells, minlength=len(counts))
                    begin = end
            yield slice(at, at + len(part)), counts.reshape(len(part), len(self)), sizes

    def _products(self, batch: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        width = len(self.vocabulary)
        rows = max(1, SLAB_CELLS // max(len(self), width))
        for at in range(0, len(batch), rows):
            part = batch[at : at + rows]
            sizes = np.array([len(s) for s in part], dtype=np.int64)
            elements, owners = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
            found = np.searchsorted(self.vocabulary, elements)
            found[found == width] = 0
            known = self.vocabulary[found] == elements
            held = np.zeros((len(part), width), dtype=np.float32)
            np.add.at(held, (owners[known], found[known]), 1)
            yield slice(at, at + len(part)), held @ self.matrix, sizes

    def tanimoto(self, batch: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        """Yield similarity matrices; two empty sets are identical."""
        whole = self.sizes.astype(np.float64)
        for at, common, sizes in self.overlaps(batch):
            union = sizes.astype(np.float64)[:, None] + whole
            union -= common
            empty = np.ix_(sizes == 0, self.sizes == 0)
            union[empty] = 1.0
            similarity = np.divide(common, union, out=union)
            similarity[empty] = 1.0
            yield at, similarity
