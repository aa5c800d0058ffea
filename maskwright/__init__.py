"""A PySpark engine that finds and masks personal data in text columns."""

from maskwright.operators.engine import SCHEMA_VERSION, AutoEngine, RedactionEngine
from maskwright.sources.packs import EntityConfig, LanguagePack, installed_languages, register_language
from maskwright.sources.rules import RegexRule, load_rules, parse_rules

__version__ = "0.1.0"
__all__ = ["SCHEMA_VERSION", "AutoEngine", "EntityConfig", "LanguagePack", "RedactionEngine", "RegexRule", "__version__", "installed_languages", "load_rules", "parse_rules", "register_language"]
