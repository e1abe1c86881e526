"""Configuration of a disclosure office: recognisers, exemption codes, domains, page numbering."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    """One regular expression of a recogniser. Classes are ASCII and there is no look-around, so that engines agree; edges of words are
    part of the expression, so that what a match would need is not taken by one that has none.

    ``check``: "luhn" or "ssn", a test of the match. ``needs``: a text that every match holds; where it is missing, nothing is searched.
    """

    entity: str
    recognizer: str
    regex: str
    score: float = 0.5
    check: str | None = None
    needs: str | None = None


#: Built-in recognisers, written from the formats' public definitions.
BUILTIN = {
    "US_SSN": Pattern("US_SSN", "ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85, "ssn"),
    "PHONE_NUMBER": Pattern("PHONE_NUMBER", "phone", r"(?:\+1[ .-]?[0-9]{3}[.-]|\b[0-9]{3}[.-]|(?:\+1[ .-]?)?\([0-9]{3}\) ?)[0-9]{3}[.-][0-9]{4}\b", 0.75),
    "EMAIL_ADDRESS": Pattern("EMAIL_ADDRESS", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0, needs="@"),
    "DATE_TIME": Pattern("DATE_TIME", "date", r"\b(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})\b", 0.6),
    "CREDIT_CARD": Pattern("CREDIT_CARD", "card", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", 0.9, "luhn"),
    "US_DRIVER_LICENSE": Pattern("US_DRIVER_LICENSE", "driver_license", r"\b[A-Z][0-9]{7,12}\b", 0.3),
    "US_BANK_NUMBER": Pattern("US_BANK_NUMBER", "bank", r"\b[0-9]{10,17}\b", 0.05),
    "US_ITIN": Pattern("US_ITIN", "itin", r"\b9[0-9]{2}-[5-9][0-9]-[0-9]{4}\b", 0.5),
    "US_PASSPORT": Pattern("US_PASSPORT", "passport", r"\b[A-Z][0-9]{8}\b", 0.1),
    "IBAN_CODE": Pattern("IBAN_CODE", "iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.5),
    "IP_ADDRESS": Pattern("IP_ADDRESS", "ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.6),
    "MEDICAL_LICENSE": Pattern("MEDICAL_LICENSE", "medical_license", r"\b[ABCDEFGHJKLMPRSTUX][A-Z][0-9]{7}\b", 0.4),
    "URL": Pattern("URL", "url", r"https?://[A-Za-z0-9./?&=_%#-]+", 0.6, needs="://"),
}
#: Entities that are looked for unless a configuration names others (fixed values).
DEFAULT_BUILTIN = ("US_SSN", "PHONE_NUMBER", "EMAIL_ADDRESS", "DATE_TIME", "CREDIT_CARD", "US_DRIVER_LICENSE", "US_BANK_NUMBER")


@dataclass(frozen=True)
class Bates:
    prefix: str = "PROD"
    start: int = 1
    width: int = 6


@dataclass(frozen=True)
class AiConfig:
    """Where advisory flags come from; "null" raises none."""

    enabled: bool = False
    provider: str = "null"
    model: str | None = None
    base_url: str | None = None
    api_key_env: str = "SPARKVEIL_AI_KEY"
    max_input_chars: int = 8000


@dataclass(frozen=True)
class Config:
    name: str = "default"
    email_domains: tuple[str, ...] = ()
    patterns: tuple[Pattern, ...] = tuple(BUILTIN[k] for k in DEFAULT_BUILTIN)
    min_score: float = 0.3
    exemption_codes: tuple[str, ...] = ()
    entity_exemptions: dict[str, str] = field(default_factory=dict)
    default_exemption: str | None = None
    bates: Bates = Bates()
    ai: AiConfig = AiConfig()
    departments: dict[str, str] = field(default_factory=dict)

    def exemption_for(self, entity: str) -> str | None:
        return self.entity_exemptions.get(entity, self.default_exemption)

    def knows(self, code: str | None) -> bool:
        return bool(code) and (not self.exemption_codes or code in self.exemption_codes)


def _patterns(raw: dict) -> tuple[Pattern, ...]:
    names = raw.get("builtins", list(DEFAULT_BUILTIN))
    found = [BUILTIN[n] for n in names if n in BUILTIN]  # an unknown name is skipped
    for r in raw.get("custom_recognizers", []):
        if not r.get("name") or not r.get("entity_type") or not r.get("patterns"):
            raise ConfigError("a custom recognizer needs name, entity_type and at least one pattern")
        for p in r["patterns"]:
            try:
                re.compile(p["regex"])
            except re.error as e:
                raise ConfigError(f"{r['name']}: {e}") from e
            found.append(Pattern(r["entity_type"], r["name"], p["regex"], float(p.get("score", 0.5))))
    return tuple(found)


def parse(raw: dict | None) -> Config:
    raw = raw or {}
    pii, exemptions, bates = raw.get("pii_detection", {}), raw.get("exemptions", {}), raw.get("bates", {})
    score = float(pii.get("min_score", 0.3))
    if not 0 <= score <= 1:
        raise ConfigError("min_score must be in [0, 1]")
    if int(bates.get("width", 6)) < 1 or int(bates.get("start", 1)) < 0:
        raise ConfigError("bates needs a positive width and a start of at least 0")
    ai = raw.get("ai", {}) or {}
    if int(ai.get("max_input_chars", 8000)) < 1:
        raise ConfigError("max_input_chars must be positive")
    departments = raw.get("departments", {}) or {}
    if not isinstance(departments, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in departments.items()):
        raise ConfigError("departments map names to descriptions")
    return Config(
        ai=AiConfig(bool(ai.get("enabled", False)), str(ai.get("provider") or "null").lower(), ai.get("model"), ai.get("base_url"), ai.get("api_key_env", AiConfig.api_key_env), int(ai.get("max_input_chars", 8000))),
        departments=dict(departments),
        name=raw.get("name", "default"),
        email_domains=tuple(d.lower().lstrip(".") for d in raw.get("email_domains", [])),
        patterns=_patterns(pii),
        min_score=score,
        exemption_codes=tuple(exemptions.get("codes", [])),
        entity_exemptions=dict(exemptions.get("entity_map", {})),
        default_exemption=exemptions.get("default"),
        bates=Bates(bates.get("prefix", "PROD"), int(bates.get("start", 1)), int(bates.get("width", 6))),
    )


def load(path: str | None) -> Config:
    """From a YAML or JSON file; without one, the defaults."""
    if path is None or not Path(path).exists():
        return Config()
    text = Path(path).read_text()
    if path.endswith(".json"):
        return parse(json.loads(text))
    import yaml

    return parse(yaml.safe_load(text))


#: The configuration that the registered queries run under.
SAMPLE = Config(
    name="sample",
    email_domains=("example.org", "mail1.example.com"),
    patterns=(
        *(BUILTIN[k] for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS")),
        Pattern("SECRET", "token", r'token = "[0-9a-f]{40}"', 0.8, needs='token = "'),
        Pattern("CREDIT_CARD", "digits", r"\b[0-9]{13,16}\b", 0.4),
    ),
    exemption_codes=("PII", "SECURITY", "FIN"),
    entity_exemptions={"EMAIL_ADDRESS": "PII", "PHONE_NUMBER": "PII", "CREDIT_CARD": "FIN", "SECRET": "SECURITY", "IP_ADDRESS": "NETWORK"},
    bates=Bates("PROD", 1, 6),
)
