"""Settings of a run: nine switches, languages and engines, read from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def as_switch(value: str | bool, strict: bool = True) -> bool:
    """A switch from text; anything but YES and NO is an error, or false where ``strict`` is."""
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if strict and text not in YES + NO:
        raise ValueError(f"{value!r} is no switch: {', '.join(YES)} or {', '.join(NO)}")
    return text in YES


@dataclass(frozen=True)
class Options:
    """The switches come first; a setting that is not given keeps its default."""

    review: bool = True
    structural_context: bool = False
    nmt_fallback: bool = True
    preserve_anchors: bool = True
    docstrings: bool = True
    code_comments: bool = True
    front_matter: bool = True
    math_single_dollar: bool = False
    mdx: bool = False
    engine: str = "pseudo"
    source_lang: str = ""
    formality: str = ""
    max_attempts: int = 2
    batch_segments: int = 40
    batch_chars: int = 12000

    @classmethod
    def switches(cls) -> list[str]:
        return [f.name for f in fields(cls) if isinstance(f.default, bool)]

    @classmethod
    def read(cls, values: Mapping[str, object], prefix: str = "", strict: bool = True) -> Options:
        """Settings named prefix + NAME, in any case and with or without underscores; numbers that are not
        positive keep the default."""
        plain = lambda k: k.replace("_", "").lower()
        given = {plain(k): v for k, v in values.items()}
        found: dict[str, object] = {}
        for f in fields(cls):
            v = given.get(plain(prefix + f.name))
            if v is None or (isinstance(v, str) and not v.strip()):
                continue
            if isinstance(f.default, bool):
                found[f.name] = as_switch(v, strict)
            elif isinstance(f.default, int):
                n = str(v).strip()
                if n.isdigit() and int(n) > 0:
                    found[f.name] = int(n)
            else:
                found[f.name] = str(v).strip()
        return cls(**found)

    def flipped(self, switch: str) -> Options:
        return replace(self, **{switch: not getattr(self, switch)})
