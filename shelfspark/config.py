"""Configuration, read from YAML on the driver."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

UNCATEGORIZED = "Uncategorized"


@dataclass
class General:
    working_folder: str = ""
    library_folder: str = ""
    log_folder: str = ""
    filename_format: str = "{title} ({year}) - {author}"
    pdf_cover_page_limit: int = 0
    scan_concurrency: int = 0


@dataclass
class Rule:
    match_field: str
    match_value: str
    category: str = ""
    subcategory: str = ""


@dataclass
class Config:
    general: General = field(default_factory=General)
    known_junk_tags: list[str] = field(default_factory=list)
    hyphen_exceptions: list[str] = field(default_factory=list)
    categories: dict[str, list[str]] = field(default_factory=dict)  # in order of declaration
    rules: list[Rule] = field(default_factory=list)


def _section(data: dict, name: str) -> dict:
    found = data.get(name)
    return found if isinstance(found, dict) else {}


def from_mapping(data: dict | None) -> Config:
    """Unknown keys are ignored and absent ones take their defaults."""
    data = data or {}
    known = General.__dataclass_fields__
    general = General(**{k: v for k, v in _section(data, "general").items() if k in known and v is not None})
    categories = {str(name): [str(s) for s in (_section({"c": body}, "c").get("subcategories") or [])] for name, body in _section(data, "categories").items()}
    rules = [Rule(*(str(r.get(k) or "") for k in ("match_field", "match_value", "category", "subcategory"))) for r in data.get("rules") or []]
    return Config(general, list(_section(data, "heuristics").get("known_junk_tags") or []), list(_section(data, "title_formatting").get("hyphen_exceptions") or []), categories, rules)


def to_mapping(config: Config) -> dict:
    return {
        "general": asdict(config.general),
        "heuristics": {"known_junk_tags": config.known_junk_tags},
        "title_formatting": {"hyphen_exceptions": config.hyphen_exceptions},
        "categories": {k: {"subcategories": v} for k, v in config.categories.items()},
        "rules": [asdict(r) for r in config.rules],
    }


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f))


def save(path: str, config: Config) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(to_mapping(config), f, allow_unicode=True, sort_keys=False)


def rule_warnings(config: Config) -> list[str]:
    """One message for each filename rule whose pattern cannot be used."""
    from .functions.patterns import translate

    out = []
    for i, rule in enumerate(config.rules, 1):
        if rule.match_field == "filename":
            try:
                translate(rule.match_value)
            except re.error as e:
                out.append(f'rule {i} (match_value "{rule.match_value}"): invalid regex: {e}')
    return out
