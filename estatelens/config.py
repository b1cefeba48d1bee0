"""Dictionaries, weights and exclusions: layered YAML merge, and their tables.

A configuration folder holds ``classification/base.yaml``, ``classification/weights.yaml``,
``dictionaries/industry/<industry>.yaml`` and ``retention/<industry>.yaml``; a client file may add
a third layer. Lists are extended without repeats in order of the layers, the first layer that
defines a type gives its domain and layer number, abbreviations are overridden key by key. All
terms are lower-cased; patterns that do not compile are skipped with a warning.
"""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
SMALL_ROWS = 500_000


@dataclass(frozen=True)
class TypeDef:
    name: str
    tokens: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    belongs_to: str = "universal"
    extensions: tuple[str, ...] = ()
    layer: int = 0


@dataclass(frozen=True)
class CategoryDef:
    name: str
    signals: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    scheme_signal: bool = False


@dataclass(frozen=True)
class EntityDef:
    name: str
    tokens: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    expansions: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class SchemeExclusions:
    names: tuple[str, ...] = ()
    substrings: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Retention:
    """type -> (years or None for permanent, basis, sensitivity)."""

    rules: dict[str, tuple[int | None, str, str]] = field(default_factory=dict)
    default_years: int = 6
    default_sensitivity: str = "medium"


#: Weights of signals and thresholds.
WEIGHTS: dict = {
    "signal_weights": {"folder_type": 0.50, "folder_category": 0.50, "filename_token": 0.85, "filename_abbreviation": 0.65, "filename_pattern": 0.75, "extension_hint": 0.20},
    "reinforcement": {"type_agreement_boost": 0.10, "category_domain_boost": 0.05},
    "conflict": {"type_disagreement_penalty": 0.10},
    "parent_child_boost": 0.05,
    "parent_child": {"Handover Pack": ["Certificate", "Drawing", "Photo", "Report", "Risk Assessment", "Snagging List"], "Drawing": ["Floor Plan", "Topographic Survey"], "Report": ["Meeting Minutes", "Photo", "Snagging List", "Risk Assessment"]},
    "fuzzy": {"max_edit_distance": 1, "min_token_length": 5, "fuzzy_penalty": 0.15},
    "generic_types": ["Photo", "Report"],
    "generic_suppression_discount": 0.85,
    "thresholds": {"minimum_confidence": 0.15},
    "readiness": {"high_threshold": 0.50, "medium_threshold": 0.35, "unknown_status": "Not Ready"},
    "scheme_detection": {"min_entities": 3, "high_entity_threshold": 5, "high_entity_confidence": 0.85, "med_entity_confidence": 0.70, "direct_plot_children_boost": 0.10, "development_categories_boost": 0.10, "sibling_quality_threshold": 0.50, "min_scheme_name_length": 3, "max_entity_only_tokens": 3},
    "entity_extraction": {"token_confidence": 0.80, "pattern_confidence": 0.65, "abbreviation_confidence": 0.50},
    "entity_clustering": {"similarity_threshold": 0.55},
    "duplicate_detection": {"base_confidence": 0.85, "date_match_boost": 0.10, "owner_match_boost": 0.05, "copy_path_keywords": ["backup", "backups", "archive", "archived", "copy", "copies", "old", "temp", "tmp", "desktop", "bak"]},
    "place_names": {"min_length": 4},
    "pipeline": {"file_id_hash_length": 16},
}


@dataclass(frozen=True)
class Config:
    types: tuple[TypeDef, ...] = ()
    categories: tuple[CategoryDef, ...] = ()
    entities: tuple[EntityDef, ...] = ()
    exclusions: SchemeExclusions = SchemeExclusions()
    weights: dict = field(default_factory=lambda: WEIGHTS)
    place_names: frozenset[str] = frozenset()
    retention: Retention = Retention()

    def entity(self, name: str) -> EntityDef:
        return next((e for e in self.entities if e.name == name), EntityDef(name))

    def weight(self, section: str, key: str) -> float:
        """A weight of a section, by default the built-in one."""
        own = self.weights.get(section) or {}
        return own[key] if key in own else WEIGHTS[section][key]


def _merged(layers: Iterable[dict], section: str) -> dict[str, list[tuple[int, dict]]]:
    out: dict[str, list[tuple[int, dict]]] = {}
    for number, layer in enumerate(layers):
        for name, body in ((layer or {}).get(section) or {}).items():
            out.setdefault(str(name), []).append((number, body or {}))
    return out


def _union(parts: list[tuple[int, dict]], key: str, lower: bool = True) -> tuple[str, ...]:
    found: dict[str, None] = {}
    for _, body in parts:
        for item in body.get(key) or []:
            found.setdefault(str(item).lower() if lower else str(item))
    return tuple(found)


def _sound(patterns: Iterable[str]) -> tuple[str, ...]:
    out = []
    for p in patterns:
        try:
            re.compile(p, re.IGNORECASE)
            out.append(p)
        except re.error:
            log.warning("pattern skipped: %s", p)
    return tuple(out)


def merge_layers(layers: list[dict], weights: dict | None = None, place_names: Iterable[str] = (), retention: Retention | None = None) -> Config:
    """One configuration of base, industry and client layers (each a parsed YAML mapping or empty)."""
    types = [
        TypeDef(n, _union(p, "tokens"), _union(p, "abbreviations"), _sound(_union(p, "patterns", False)), next((str(b[k]) for _, b in p for k in ("belongs_to", "domain") if b.get(k)), "universal"), _union(p, "extensions"), p[0][0])
        for n, p in _merged(layers, "types").items()
    ]
    categories = [CategoryDef(n, _union(p, "signals"), _union(p, "aliases"), any(b.get("scheme_signal") for _, b in p)) for n, p in _merged(layers, "categories").items()]
    entities = []
    for n, p in _merged(layers, "entities").items():
        expansions: dict[str, str] = {}
        for _, b in p:
            expansions |= {str(k).lower(): str(v).lower() for k, v in (b.get("abbreviation_map") or {}).items()}
        entities.append(EntityDef(n, _union(p, "tokens"), _union(p, "abbreviations"), _sound(_union(p, "patterns", False)), expansions))
    ex = [(i, (layer or {}).get("scheme_exclusions") or {}) for i, layer in enumerate(layers)]
    exclusions = SchemeExclusions(_union(ex, "names"), _union(ex, "substrings"), _sound(_union(ex, "patterns", False)))
    return Config(tuple(types), tuple(categories), tuple(entities), exclusions, weights or WEIGHTS, frozenset(place_names), retention or Retention())


def _yaml(path: Path, required: bool) -> dict:
    import yaml

    if not path.exists():
        if required:
            raise FileNotFoundError(path)
        return {}
    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def load_place_names(folder: Path, least: int = 4) -> frozenset[str]:
    """Names of a text file (one per line) and of the place18nm column of a CSV file, where they exist."""
    names: set[str] = set()
    for path in sorted(folder.glob("*.txt")) if folder.exists() else []:
        names |= {line.strip().lower() for line in path.read_text(encoding="utf-8").splitlines()}
    for path in sorted(folder.glob("*.csv")) if folder.exists() else []:
        with path.open(encoding="utf-8-sig", errors="replace") as f:
            names |= {(r.get("place18nm") or "").strip().lower() for r in csv.DictReader(f)}
    return frozenset(n for n in names if len(n) >= least)


def load_retention(folder: str | Path, industry: str) -> Retention:
    """Retention rules of an industry; the file must exist."""
    body = _yaml(Path(folder) / "retention" / f"{industry}.yaml", True)
    rules = {str(n): (None if str(r.get("years")).lower() == "permanent" else int(r["years"]), str(r.get("basis", "")), str(r.get("sensitivity", body.get("default_sensitivity", "medium")))) for n, r in (body.get("rules") or {}).items()}
    return Retention(rules, int(body.get("default_retention_years", 6)), str(body.get("default_sensitivity", "medium")))


def load_config(folder: str | Path, industry: str = "", client: str | Path | None = None) -> Config:
    """Configuration of a folder; a missing industry or client file leaves its layer empty."""
    root = Path(folder)
    weights = _yaml(root / "classification" / "weights.yaml", False)
    layers = [_yaml(root / "classification" / "base.yaml", True), _yaml(root / "dictionaries" / "industry" / f"{industry}.yaml", False), _yaml(Path(client), False) if client else {}]
    least = int((weights.get("place_names") or {}).get("min_length", 4))
    retention = load_retention(root, industry) if (root / "retention" / f"{industry}.yaml").exists() else Retention()
    return merge_layers(layers, weights or None, load_place_names(root / "dictionaries", least), retention)


# built-in dictionary: a small one of our own


def default_config() -> Config:
    """A compact dictionary for file shares of building projects."""
    t = TypeDef
    types = (
        t("Invoice", ("invoice", "invoices"), ("inv",), (r"\binv[-_]?\d+",)),
        t("Certificate", ("certificate", "certificates"), ("cert",)),
        t("Photo", ("photo", "photos", "picture"), ("img",), (r"^img\d{3,}",), extensions=("jpg", "jpeg", "png")),
        t("Drawing", ("drawing", "drawings", "elevation"), ("dwg",), extensions=("dwg",)),
        t("Report", ("report", "reports"), ("rpt",)),
        t("Email", ("email",), (), (r"^(re|fw)[_ ]",), extensions=("msg",)),
        t("Lease", ("lease", "tenancy"), belongs_to="Legal"),
        t("Floor Plan", ("floor plan", "layout"), layer=1, belongs_to="Planning"),
        t("Snagging List", ("snagging list", "snag list", "snagging"), layer=1, belongs_to="Construction"),
        t("Risk Assessment", ("risk assessment", "fire risk assessment"), ("fra",), layer=1, belongs_to="Safety"),
        t("Meeting Minutes", ("meeting minutes", "minutes"), ("mins",), layer=1),
        t("Topographic Survey", ("topographic survey", "topo survey", "survey"), layer=1, belongs_to="Planning"),
        t("Purchase Order", ("purchase order",), ("po",), (r"\bpo[-_]?\d+",), layer=1, belongs_to="Finance"),
        t("Handover Pack", ("handover", "handover pack"), layer=1, belongs_to="Construction"),
        t("Warranty", ("warranty",), layer=1),
    )
    c = CategoryDef
    categories = (
        c("Finance", ("finance", "invoices", "accounts"), ("fin",)),
        c("Legal", ("legal", "contracts"), ()),
        c("Safety", ("health and safety",), ("h&s",)),
        c("Planning", ("planning",), (), True),
        c("Sales", ("sales",), (), True),
        c("Construction", ("construction", "snagging", "site"), (), True),
        c("Maintenance", ("maintenance",), (), True),
        c("Administration", ("correspondence", "archive", "admin"), ()),
    )
    plot = EntityDef("plot", ("plot", "unit", "flat"), ("plt", "blk"), (r"\bp[-_ ]?\d{1,4}[a-z]?\b", r"\bplot[-_ ]?\d{1,4}[a-z]?\b", r"\bblock[-_ ]?[a-z0-9]{1,3}\b", r"\bphase[-_ ]?\d{1,2}\b"), {"plt": "plot", "blk": "block"})
    streets = {"rd": "road", "st": "street", "ln": "lane", "ave": "avenue", "cl": "close", "ct": "court", "cres": "crescent", "gdns": "gardens", "tce": "terrace", "dr": "drive"}
    address = EntityDef("address", ("road", "street", "lane", "avenue", "close", "court", "crescent", "gardens", "terrace", "drive", "way", "park"), tuple(streets), (r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}\b",), streets)
    rules = {"Invoice": (7, "accounts", "medium"), "Certificate": (10, "validity", "high"), "Lease": (None, "title", "high"), "Risk Assessment": (None, "safety law", "high"), "Drawing": (15, "liability", "medium"), "Photo": (6, "evidence", "low"), "Email": (3, "correspondence", "low"), "Meeting Minutes": (8, "governance", "medium"), "Floor Plan": (15, "liability", "medium")}
    return Config(types, categories, (plot, address), retention=Retention(rules))


# tables


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of configuration; its size is checked."""
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"{len(rows)} rows of configuration; at most {SMALL_ROWS} are broadcast")
    return F.broadcast(spark.createDataFrame(rows, schema))


def canonical_words(config: Config) -> list[str]:
    """Words of type tokens and category signals, sorted."""
    return sorted({w for t in config.types for p in t.tokens for w in p.split()} | {w for c in config.categories for p in c.signals for w in p.split()})


def one_letter_less(word: str) -> set[str]:
    """A word and all its one-letter deletions."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def fuzzy_index(config: Config) -> list[tuple[str, str]]:
    """(deletion, word) of all words that misspellings are looked up for: about as many rows a word as it has letters."""
    least = int(config.weight("fuzzy", "min_token_length"))
    return sorted((cut, word) for word in canonical_words(config) if len(word) >= least for cut in one_letter_less(word))
