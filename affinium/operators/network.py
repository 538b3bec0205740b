"""The fusion network: a hidden layer over the text, embedding rows for ids, a hidden layer over all inputs.

It shares storage, optimiser and training with the linear fusion: its layers
are named blocks of weights and biases. The backward pass is written out.
Layer dropout is drawn per batch from a seed, so a retried task draws alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from affinium import fixed
from affinium.operators.fusion import IDS, LISTS, SCALARS, FusionModel


@dataclass
class FusionNetwork(FusionModel):
    """Blocks: `text`, `text_out`, one per metadata input, `<id input>_proj`, `fuse` and `fuse_out`."""

    @classmethod
    def create(cls, text_dim: int, sizes: dict[str, int], embed_dim: int = fixed.EMBED_DIM, seed: int = fixed.SEED,
               hidden: int = fixed.HIDDEN, id_dim: int = fixed.ID_DIM) -> FusionNetwork:
        """Seeded start; inputs with an empty vocabulary are left out."""
        rng = np.random.default_rng(seed)
        weights, bias = {}, {}

        def linear(name: str, size: int, width: int) -> None:
            limit = 1.0 / np.sqrt(size)
            weights[name] = rng.uniform(-limit, limit, (size, width))
            bias[name] = rng.uniform(-limit, limit, width)

        linear("text", text_dim, hidden)
        linear("text_out", hidden, embed_dim)
        for name in LISTS:
            if sizes[name] > 0:
                linear(name, sizes[name], embed_dim)
        for name in IDS:
            if sizes[name] > 0:
                weights[name] = rng.standard_normal((sizes[name], id_dim))
                linear(f"{name}_proj", id_dim, embed_dim)
        for name in SCALARS:
            linear(name, 1, embed_dim)
        inputs = 1 + sum(name in weights for name in fixed.MODALITIES)
        linear("fuse", inputs * embed_dim, hidden)
        linear("fuse_out", hidden, embed_dim)
        return cls(weights, bias)

    @property
    def embed_dim(self) -> int:
        return self.bias["fuse_out"].shape[0]

    def _part(self, name: str, value, n: int) -> np.ndarray:
        block = self.weights[name]
        if name in LISTS:
            rows, entries = value
            out = np.zeros((n, block.shape[1]))
            np.add.at(out, rows, block[entries])
            return out + self.bias[name]
        if name in IDS:
            return block[value] @ self.weights[f"{name}_proj"] + self.bias[f"{name}_proj"]
        return value[:, None] * block[0] + self.bias[name]

    def _hidden(self, name: str, x: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray]:
        """Rectified layer and what its gradient is multiplied by."""
        raw = x @ self.weights[name] + self.bias[name]
        gate = (raw > 0).astype(float)
        if rng is not None:
            gate *= (rng.random(raw.shape) >= fixed.LAYER_DROPOUT) / (1 - fixed.LAYER_DROPOUT)
        return raw * gate, gate

    def forward(self, inputs: dict, keep: np.ndarray | None, rng: np.random.Generator | None = None):
        """Unit vectors, and what the backward pass needs; without `rng` no unit is dropped."""
        n = len(inputs["text"])
        text, text_gate = self._hidden("text", inputs["text"], rng)
        parts = [text @ self.weights["text_out"] + self.bias["text_out"]]
        for at, name in enumerate(fixed.MODALITIES):
            if name in self.weights:
                part = self._part(name, inputs[name], n)
                parts.append(part if keep is None else part * keep[:, at : at + 1])
        joined = np.concatenate(parts, axis=1)
        hidden, gate = self._hidden("fuse", joined, rng)
        total = hidden @ self.weights["fuse_out"] + self.bias["fuse_out"]
        lengths = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        z = total / lengths
        return z, (inputs, keep, text, text_gate, joined, hidden, gate, z, lengths)

    def _back(self, name: str, x: np.ndarray, dy: np.ndarray, into: FusionModel) -> np.ndarray:
        """Gradient of a linear layer; returns that of its input."""
        into.weights[name] += x.T @ dy
        into.bias[name] += dy.sum(axis=0)
        return dy @ self.weights[name].T

    def backward(self, tape: tuple, dz: np.ndarray, into: FusionModel) -> None:
        """Add the parameter gradient of one batch to `into`."""
        inputs, keep, text, text_gate, joined, hidden, gate, z, lengths = tape
        du = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / lengths
        d_joined = self._back("fuse", joined, self._back("fuse_out", hidden, du, into) * gate, into)
        width = self.bias["text_out"].shape[0]
        d_text = self._back("text_out", text, d_joined[:, :width], into)
        self._back("text", inputs["text"], d_text * text_gate, into)
        place = 1
        for at, name in enumerate(fixed.MODALITIES):
            if name not in self.weights:
                continue
            part = d_joined[:, place * width : (place + 1) * width]
            place += 1
            if keep is not None:
                part = part * keep[:, at : at + 1]
            if name in LISTS:
                rows, entries = inputs[name]
                np.add.at(into.weights[name], entries, part[rows])
                into.bias[name] += part.sum(axis=0)
            elif name in IDS:
                rows = self._back(f"{name}_proj", self.weights[name][inputs[name]], part, into)
                np.add.at(into.weights[name], inputs[name], rows)
            else:
                into.weights[name][0] += inputs[name] @ part
                into.bias[name] += part.sum(axis=0)
