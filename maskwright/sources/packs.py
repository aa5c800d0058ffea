"""Language packs: rules and entity configuration of a language, and their registry."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from importlib.resources import files
from pathlib import Path

import yaml

from maskwright.functions.bioes import ENTITIES, OPERATING_POINTS, label_list
from maskwright.functions.spans import NerPrecedence, SpanTrim
from maskwright.sources.rules import RegexRule, load_rules

ENTRY_POINTS = "maskwright.languages"
RULES_FILE, CONFIG_FILE = "regex_rules.yaml", "entity_config.yaml"


def _text(value) -> bool:
    return isinstance(value, str) and value != ""


def _entries(data, key: str) -> list[dict]:
    return [x for x in ((data or {}).get(key) or []) if isinstance(x, dict)]


def _count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 1


#: Fields of an entry by section: what stands for a missing one, and what it must be.
_FIELDS = {
    "ner_precedence": {"label": (None, _text), "over": (None, lambda x: isinstance(x, list))},
    "span_trim": {
        "label": (None, _text),
        "after": ("", lambda x: isinstance(x, str)),
        "suffixes": (None, lambda x: isinstance(x, list)),
        "min_keep": (1, _count),
    },
}


def _well_formed(data: Mapping | None, section: str) -> Iterator[dict]:
    """The fields of the entries of a section that are as they must be."""
    fields = _FIELDS[section]
    for entry in _entries(data, section):
        found = {name: entry.get(name, missing) for name, (missing, _) in fields.items()}
        if all(check(found[name]) for name, (_, check) in fields.items()):
            yield found


def parse_ner_precedence(data: Mapping | None) -> tuple[NerPrecedence, ...]:
    """Well-formed ``ner_precedence`` entries that beat another label."""
    beaten = [(x["label"], tuple(filter(_text, x["over"]))) for x in _well_formed(data, "ner_precedence")]
    others = [(label, tuple(o for o in over if o != label)) for label, over in beaten]
    return tuple(NerPrecedence(label, over) for label, over in others if over)


def parse_span_trims(data: Mapping | None) -> tuple[SpanTrim, ...]:
    """Well-formed ``span_trim`` entries; a rule without an anchor keeps 2 or more."""
    read = [(x, tuple(filter(_text, x["suffixes"]))) for x in _well_formed(data, "span_trim")]
    return tuple(SpanTrim(x["label"], x["after"], own, x["min_keep"]) for x, own in read if own and (x["after"] or x["min_keep"] > 1))


def parse_stopwords(data: Mapping | None) -> frozenset[str]:
    return frozenset(w.strip() for w in ((data or {}).get("stopwords") or []) if isinstance(w, str) and w.strip())


def parse_operating_point(data: Mapping | None) -> str | None:
    name = (data or {}).get("default_operating_point")
    return name if isinstance(name, str) and name in OPERATING_POINTS else None


@dataclass(frozen=True)
class EntityConfig:
    stopwords: frozenset[str] = frozenset()
    span_trims: tuple[SpanTrim, ...] = ()
    ner_precedence: tuple[NerPrecedence, ...] = ()
    operating_point: str | None = None

    @classmethod
    def parse(cls, data: Mapping | None) -> EntityConfig:
        return cls(parse_stopwords(data), parse_span_trims(data), parse_ner_precedence(data), parse_operating_point(data))

    @classmethod
    def load(cls, path: str | Path) -> EntityConfig:
        """The file's configuration, empty if there is none."""
        try:
            return cls.parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
        except OSError:
            return cls()


@dataclass(frozen=True)
class LanguagePack:
    """A language's registration; ``package`` or ``folder`` holds its two YAML files."""

    code: str
    display_name: str = ""
    default_weights: str = ""
    package: str = ""
    scripts: tuple[str, ...] = ()
    default_base_model: str = ""
    folder: str = ""
    given_rules: tuple[RegexRule, ...] | None = field(default=None, compare=False)
    given_config: EntityConfig | None = field(default=None, compare=False)

    def resource(self, name: str) -> Path:
        return Path(self.folder) / name if self.folder else Path(str(files(self.package) / name))

    def rules(self) -> list[RegexRule]:
        return list(self.given_rules) if self.given_rules is not None else load_rules(self.resource(RULES_FILE))

    def config(self) -> EntityConfig:
        return self.given_config if self.given_config is not None else EntityConfig.load(self.resource(CONFIG_FILE))


_registered: dict[str, LanguagePack] = {}
_discovered: dict[str, LanguagePack] | None = None


def register_language(pack: LanguagePack) -> None:
    """Add or replace a pack by its code."""
    _registered[pack.code] = pack


def unregister_language(code: str) -> None:
    _registered.pop(code, None)


def installed_languages() -> dict[str, LanguagePack]:
    """Packs of installed distributions, found once, and registered ones."""
    global _discovered
    if _discovered is None:
        loaded = [point.load() for point in entry_points(group=ENTRY_POINTS)]
        _discovered = {x.code: x for x in loaded if isinstance(x, LanguagePack)}
    return _discovered | _registered


def get_language(code: str) -> LanguagePack:
    known = installed_languages()
    if code not in known:
        raise ValueError(f"no language pack {code!r}; there are: {', '.join(sorted(known)) or 'none'}")
    return known[code]


def resolve_language(code: str | None = None) -> LanguagePack:
    """The named pack, or the only one."""
    if code is not None:
        return get_language(code)
    known = installed_languages()
    if len(known) == 1:
        return next(iter(known.values()))
    if not known:
        raise ValueError("no language pack is installed or registered")
    raise ValueError(f"there are several language packs ({', '.join(sorted(known))}); name one or route texts automatically")


@dataclass(frozen=True)
class LabelSpace:
    labels: tuple[str, ...]
    label_map: Mapping[str, str]

    def remap(self, label: str) -> str | None:
        return label if not self.label_map else self.label_map.get(label)


def load_label_space(path: str | Path | None = None) -> LabelSpace:
    """The default entities, or the distinct targets of a JSON ``label_map`` in order."""
    if not path:
        return LabelSpace(tuple(label_list(ENTITIES)), {})
    label_map = json.loads(Path(path).read_text(encoding="utf-8"))["label_map"]
    return LabelSpace(tuple(label_list(list(dict.fromkeys(label_map.values())))), label_map)


def resolve_weights(name: str, fetch: Callable[[str], str] | None = None) -> Path:
    """The folder of a local model bundle; ``fetch`` may bring others."""
    folder = Path(name).expanduser()
    if (folder / "bundle.json").exists():
        return folder
    if fetch is None:
        raise FileNotFoundError(f"no model bundle in {name}; give a local folder or a fetch function")
    return Path(fetch(name))
