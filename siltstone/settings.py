"""Settings: one table of fields with kinds, defaults and ranges; a mapping of texts becomes checked values or an error at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from types import SimpleNamespace

from .functions.seams import CHANNELS, backend
from .operators.search import MODALITIES

TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


@dataclass(frozen=True)
class Field:
    """A setting `group.name`. Without a default it is required; `low` and `high` are inclusive."""

    name: str
    kind: str
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    required: bool = False


# Settings with their defaults.
FIELDS = [
    Field("text.summary_max_chars", "int", 1000, low=1),
    Field("text.top_k_keywords", "int", 10, low=1),
    Field("text.chunk_size", "int", 2000, low=1),
    Field("text.chunk_overlap", "int", 0, low=0),
    Field("embed.model", "text", required=True),
    Field("embed.channel", "text", "st", choices=tuple(CHANNELS)),
    Field("embed.normalise", "flag", True),
    Field("embed.api_base_url", "text", ""),
    Field("embed.api_timeout_s", "number", 30.0, low=0),
    Field("embed.api_batch_size", "int", 32, low=1),
    Field("embed.api_max_retries", "int", 2, low=0),
    Field("embed.chunk_size", "int", 1000, low=1),
    Field("embed.chunk_overlap", "int", 0, low=0),
    Field("search.fusion_weights", "pair", (0.5, 0.5), low=0, high=1),
    Field("search.cutoff_enabled", "flag", True),
    Field("search.cutoff_eps", "number", 0.18, low=0, high=1),
    Field("search.cutoff_floor", "number", 0.35, low=0, high=1),
    Field("search.result_floor", "number", 0.20, low=0, high=1),
    Field("search.bm25_operator", "text", "and", choices=("and", "or")),
    Field("search.rerank_enabled", "flag", False),
    Field("search.rerank_top_r", "int", 10, low=1),
    Field("search.rerank_tau", "number", 0.0, low=0, high=1),
    Field("search.query_norm_enabled", "flag", False),
    Field("search.query_norm_method", "text", "morph", choices=("morph", "llm")),
    Field("search.about_filter_enabled", "flag", False),
    Field("search.verify_enabled", "flag", False),
    Field("search.evidence_rescue_enabled", "flag", True),
    Field("search.index_sync_enabled", "flag", True),
    Field("relations.top_k", "int", 10, low=1),
    Field("relations.path_top_k", "int", 10, low=0),
    Field("relations.min_sim", "number", 0.2, low=0, high=1),
    Field("relations.auto_approve_min", "number", 1.01, low=0),
    Field("relations.auto_approve_emb_min", "number", 0.0, low=0, high=1),
    Field("relations.persist_floor", "number", 0.70, low=0, high=1),
    Field("relations.auto_approve_exclude_kinds", "kinds", "same_domain"),
    Field("relations.review_exempt_kinds", "kinds", "same_domain"),
    Field("relations.strip_id_prefix", "flag", False),
    Field("relations.retry_max_attempts", "int", 3, low=1),
    Field("video.max_keyframes", "int", 8, low=1),
    Field("video.labels_top_k", "int", 5, low=0),
    Field("image.labels_top_k", "int", 10, low=0),
    Field("image.label_score_min", "number", 0.1, low=0, high=1),
    Field("topic.canonicalise_enabled", "flag", False),
]


def parse_kinds(raw: str | None, default: frozenset[str] = frozenset()) -> frozenset[str]:
    """Lower-cased codes of a comma list; None means the default, an empty text the empty set (that is how a gate is turned off)."""
    return default if raw is None else frozenset(x.strip().lower() for x in raw.split(",") if x.strip())


def parse_modalities(raw: str | None) -> list[str] | None:
    """Labels of a comma list as they are written; None where there are none, for all buckets."""
    return [x.strip() for x in (raw or "").split(",") if x.strip()] or None


def checked_modalities(raw: str | None) -> list[str]:
    """The buckets that a request names, all of them if none; an unknown one is an error."""
    wanted = parse_modalities(raw) or list(MODALITIES)
    if unknown := [m for m in wanted if m not in MODALITIES]:
        raise ValueError(f"unknown modality: {unknown}")
    return wanted


def _flag(raw: str) -> bool:
    if raw.lower() in TRUE:
        return True
    if raw.lower() in FALSE:
        return False
    raise ValueError("not a flag")


def _pair(raw: str) -> tuple[float, ...]:
    out = tuple(float(x) for x in raw.split(","))
    if len(out) != 2:
        raise ValueError("two numbers are needed")
    return out


_READ: dict[str, Callable[[str], object]] = {"int": int, "number": float, "flag": _flag, "text": str, "pair": _pair, "kinds": parse_kinds}


def _value(field: Field, raw: str | None) -> object:
    # an empty text is a value of a kind list alone; elsewhere it counts as not set
    if raw is None or field.kind != "kinds" and not raw.strip():
        if field.required:
            raise ValueError(f"{field.name} is not set")
        return parse_kinds(field.default) if field.kind == "kinds" else field.default
    try:
        out = _READ[field.kind](raw.strip())
    except ValueError as e:
        raise ValueError(f"{field.name} = {raw!r}: {e}") from None
    for x in out if isinstance(out, tuple) else (out,):
        if field.low is not None and not x >= field.low or field.high is not None and not x <= field.high:
            raise ValueError(f"{field.name} = {raw!r}: outside {field.low} .. {field.high}")
    if field.choices and out not in field.choices:
        raise ValueError(f"{field.name} = {raw!r}: not one of {', '.join(field.choices)}")
    return out


def load(raw: Mapping[str, str]) -> SimpleNamespace:
    """Settings by group (settings.search.cutoff_eps) from texts by name; a bad value or a contradiction is an error, unknown names are ignored."""
    out: dict[str, SimpleNamespace] = {}
    for f in FIELDS:
        group, _, name = f.name.partition(".")
        setattr(out.setdefault(group, SimpleNamespace()), name, _value(f, raw.get(f.name)))
    s = SimpleNamespace(**out)
    if not s.search.index_sync_enabled:
        raise ValueError("search reads the index, so index_sync_enabled has to be on")
    if backend(s.embed.channel) == "remote" and not s.embed.api_base_url:
        raise ValueError(f"channel {s.embed.channel} needs embed.api_base_url")
    for g in (s.text, s.embed):
        if g.chunk_overlap >= g.chunk_size:
            raise ValueError("a chunk's overlap has to be smaller than its size")
    return s
