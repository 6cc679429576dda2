"""Model folders: config.json, vocab.txt and model.safetensors, checked in full on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

import numpy as np

from ..errors import ConfigError, JsonError, ModelError
from .safetensors import SafeTensors, write


@dataclass(frozen=True)
class ModelConfig:
    vocab_size: int
    hidden_size: int
    num_hidden_layers: int
    num_attention_heads: int
    intermediate_size: int
    max_position_embeddings: int
    layer_norm_eps: float = 1e-12
    hidden_act: str = "gelu"  # read, but the activation is always the tanh form
    type_vocab_size: int = 2
    model_type: str | None = None

    def __post_init__(self) -> None:
        if self.hidden_size <= 0:
            raise ConfigError("hidden_size", "must be positive")
        if self.num_attention_heads <= 0:
            raise ConfigError("num_attention_heads", "must be positive")
        if self.hidden_size % self.num_attention_heads:
            raise ConfigError("hidden_size", "must be a multiple of num_attention_heads")

    @classmethod
    def parse(cls, text: str) -> ModelConfig:
        try:
            found = json.loads(text)
        except ValueError as e:
            raise JsonError(str(e)) from e
        if not isinstance(found, dict):
            raise JsonError("the configuration is no object")
        known = {f.name: f for f in fields(cls)}
        for name in list(known)[:6]:
            if not isinstance(found.get(name), int) or isinstance(found.get(name), bool) or found[name] < 0:
                raise ConfigError(name, "must be a whole number")
        return cls(**{k: v for k, v in found.items() if k in known})

    @property
    def head_dim(self) -> int:
        return self.hidden_size // self.num_attention_heads

    @property
    def is_distilbert(self) -> bool:
        return self.model_type == "distilbert"

    @property
    def is_bert(self) -> bool:
        return not self.is_distilbert


@dataclass
class Layer:
    """One encoder layer; matrices are stored input x output, ready to multiply from the right."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    up: np.ndarray
    down: np.ndarray
    q_bias: np.ndarray
    k_bias: np.ndarray
    v_bias: np.ndarray
    o_bias: np.ndarray
    up_bias: np.ndarray
    down_bias: np.ndarray
    attention_gamma: np.ndarray
    attention_beta: np.ndarray
    output_gamma: np.ndarray
    output_beta: np.ndarray


@dataclass
class ModelWeights:
    words: np.ndarray
    positions: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray
    types: np.ndarray | None = None
    layers: list[Layer] = field(default_factory=list)


_BERT = {
    "q": "attention.self.query", "k": "attention.self.key", "v": "attention.self.value", "o": "attention.output.dense",
    "up": "intermediate.dense", "down": "output.dense", "attention": "attention.output.LayerNorm", "output": "output.LayerNorm",
}
_DISTIL = {
    "q": "attention.q_lin", "k": "attention.k_lin", "v": "attention.v_lin", "o": "attention.out_lin",
    "up": "ffn.lin1", "down": "ffn.lin2", "attention": "sa_layer_norm", "output": "output_layer_norm",
}


def assemble(config: ModelConfig, tensors: SafeTensors) -> ModelWeights:
    """The weights of either family, every shape checked, matrices transposed once."""
    distil = config.is_distilbert
    prefixes = ("distilbert.", "") if distil else ("", "bert.")
    layer_at = "transformer.layer" if distil else "encoder.layer"
    names = _DISTIL if distil else _BERT
    h, inner = config.hidden_size, config.intermediate_size

    def get(name: str, *shape: int, optional: bool = False) -> np.ndarray | None:
        for prefix in prefixes:
            if prefix + name in tensors:
                found = tensors.tensor(prefix + name)
                if found.shape != shape:
                    raise ModelError(f"{prefix + name} has the shape {list(found.shape)}, not {list(shape)}")
                return found
        if optional:
            return None
        raise ModelError(f"there is no tensor {name}")

    weights = ModelWeights(
        words=get("embeddings.word_embeddings.weight", config.vocab_size, h),
        positions=get("embeddings.position_embeddings.weight", config.max_position_embeddings, h),
        gamma=get("embeddings.LayerNorm.weight", h),
        beta=get("embeddings.LayerNorm.bias", h),
        types=None if distil else get("embeddings.token_type_embeddings.weight", config.type_vocab_size, h, optional=True),
    )
    sizes = {"q": (h, h), "k": (h, h), "v": (h, h), "o": (h, h), "up": (inner, h), "down": (h, inner)}
    for n in range(config.num_hidden_layers):
        own = {}
        for short, shape in sizes.items():
            at = f"{layer_at}.{n}.{names[short]}"
            own[short] = np.ascontiguousarray(get(f"{at}.weight", *shape).T)
            own[f"{short}_bias"] = get(f"{at}.bias", shape[0])
        for short in ("attention", "output"):
            at = f"{layer_at}.{n}.{names[short]}"
            own[f"{short}_gamma"], own[f"{short}_beta"] = get(f"{at}.weight", h), get(f"{at}.bias", h)
        weights.layers.append(Layer(**own))
    return weights


def tensor_names(config: ModelConfig) -> dict[str, tuple[int, ...]]:
    """Every tensor of a model of this configuration, and its shape."""
    distil, h, inner = config.is_distilbert, config.hidden_size, config.intermediate_size
    prefix, layer_at, names = ("distilbert.", "transformer.layer", _DISTIL) if distil else ("", "encoder.layer", _BERT)
    out = {
        f"{prefix}embeddings.word_embeddings.weight": (config.vocab_size, h),
        f"{prefix}embeddings.position_embeddings.weight": (config.max_position_embeddings, h),
        f"{prefix}embeddings.LayerNorm.weight": (h,),
        f"{prefix}embeddings.LayerNorm.bias": (h,),
    }
    if not distil:
        out["embeddings.token_type_embeddings.weight"] = (config.type_vocab_size, h)
    for n in range(config.num_hidden_layers):
        for short, shape in {"q": (h, h), "k": (h, h), "v": (h, h), "o": (h, h), "up": (inner, h), "down": (h, inner), "attention": (h,), "output": (h,)}.items():
            out[f"{prefix}{layer_at}.{n}.{names[short]}.weight"] = shape
            out[f"{prefix}{layer_at}.{n}.{names[short]}.bias"] = shape[:1]
    return out


def seeded(config: ModelConfig, seed: int = 1) -> dict[str, np.ndarray]:
    """Random tensors in which every part of the encoder matters: for tests and demonstrations."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in tensor_names(config).items():
        norm = "norm" in name.lower()
        out[name] = (rng.normal(0, 0.2 if norm else 0.5, shape) + (norm and name.endswith("weight"))).astype(np.float32)
    return out


def write_folder(folder: str, config: ModelConfig, tokens: list[str], tensors: dict[str, np.ndarray], dtype: str = "F32") -> None:
    """A model folder that ``Embedder.load`` reads."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / "config.json").write_text(json.dumps({k: v for k, v in vars(config).items() if v is not None}))
    (path / "vocab.txt").write_text("".join(f"{t}\n" for t in tokens), encoding="utf-8")
    (path / "model.safetensors").write_bytes(write(tensors, dtype))
