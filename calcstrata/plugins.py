"""Plug-ins: rule sets that others register, their discovery, settings and life cycle."""

from __future__ import annotations

import json
import os
import uuid
import warnings
from collections.abc import Callable
from importlib.metadata import entry_points
from pathlib import Path

from pyspark.sql import Column, DataFrame

from .operators import files
from .operators.validate import Rule
from .parsers import registry

#: Entry-point groups under which packages may offer plug-ins.
GROUPS = {"validators": "calcstrata.validators", "parsers": "calcstrata.parsers", "hooks": "calcstrata.hooks"}


#: Types that plug-ins may not replace.
BUILT_IN = tuple(registry.PARSERS)


class Plugin:
    """A named extension; ``activate`` and ``deactivate`` are called when it is registered and taken out."""

    name = ""
    version = "0.1.0"
    description = ""

    def activate(self) -> None:
        pass

    def deactivate(self) -> None:
        pass


class ValidatorPlugin(Plugin):
    """Rules over one row a directory, with a text column for each named file (see ``files.directories``)."""

    priority = 50
    enabled_by_default = True

    def applies(self) -> Column:
        """A condition on ``names``, the upper-case names in a directory."""
        raise NotImplementedError

    def rules(self) -> list[Rule]:
        raise NotImplementedError

    def as_validator(self) -> files.Validator:
        return files.Validator(self.name, self.priority, self.enabled_by_default, self.applies, self.rules)


class CheckPlugin(ValidatorPlugin):
    """A validator in Python: what it raises in one directory is that directory's failed result."""

    def check(self, texts: dict[str, str | None]) -> tuple[list[str], list[str]]:
        """Errors and warnings of a directory, from the texts of its named files (None for those that it lacks)."""
        raise NotImplementedError

    def as_validator(self) -> files.Validator:
        return files.Validator(self.name, self.priority, self.enabled_by_default, self.applies, check=self.check)


class ParserPlugin(Plugin):
    """A further file type: how its files are called, parsed, compared and checked. ``name`` is the type."""

    order: tuple[str, ...] = ()
    critical: tuple[str, ...] = ()
    major: tuple[str, ...] = ()
    tolerances: dict[str, float] = {}

    def names(self, path: Column) -> Column:
        """Whether a path is of this type."""
        raise NotImplementedError

    def parse(self, table: DataFrame) -> DataFrame:
        """Facts (blob_hash, path, kind, num, value) of (blob_hash, text); see ``parsers.values``."""
        raise NotImplementedError

    def rules(self, fact: Callable[[str], Column]) -> list[Rule]:
        """Rules on the facts: ``fact(path)`` is a struct of kind, num and value, null if it is absent."""
        return []

    def enter(self) -> None:
        registry.register(self.name, self.parse, self.names, self.order, self.critical, self.major, self.tolerances)
        files.TYPE_RULES[self.name] = self.rules

    def leave(self) -> None:
        registry.unregister(self.name)
        files.TYPE_RULES.pop(self.name, None)


class _Builtin(ValidatorPlugin):
    def __init__(self, v: files.Validator):
        self.name, self.priority, self.enabled_by_default = v.name, v.priority, v.enabled
        self.applies, self.rules, self.validator = v.applies, v.rules, v
        self.description = (v.rules.__doc__ or "built in").strip()

    def as_validator(self) -> files.Validator:
        return self.validator


def read_settings(text: str | None) -> dict:
    """Settings of plug-ins by name; missing or corrupt ones are no settings."""
    try:
        told = json.loads(text or "{}")
    except ValueError:
        return {}
    return told if isinstance(told, dict) else {}


class Manager:
    """Plug-ins and their settings, kept in a JSON file with sorted keys, which is replaced as a whole.

    ``path`` is below ``files`` (see ``sources.files``) if that is given, else
    on the local disk.
    """

    def __init__(self, path: str | None = None, files_of=None):
        self.path, self.files = path, files_of
        self.settings = read_settings(self._stored())
        self.plugins: dict[str, Plugin] = {v.name: _Builtin(v) for v in files.VALIDATORS.values()}

    def _stored(self) -> str | None:
        if not self.path:
            return None
        try:
            if self.files is not None:
                return self.files.read(self.path) if self.files.exists(self.path) else None
            return Path(self.path).read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError):
            return None

    def register(self, plugin: Plugin) -> None:
        if not plugin.name:
            raise ValueError("a plug-in needs a name")
        if isinstance(plugin, ParserPlugin) and plugin.name in BUILT_IN:
            raise ValueError(f"{plugin.name} is a built-in type")
        self.unregister(plugin.name)
        plugin.activate()
        if isinstance(plugin, ParserPlugin):
            plugin.enter()
        self.plugins[plugin.name] = plugin

    def unregister(self, name: str) -> None:
        old = self.plugins.pop(name, None)
        if old is not None:
            if isinstance(old, ParserPlugin):
                old.leave()
            old.deactivate()

    def discover(self, found: Callable[[], list] | None = None) -> list[str]:
        """Register the plug-ins that installed packages offer, of every group; one that fails is left out with a warning."""
        names = []
        for point in found() if found else [p for group in GROUPS.values() for p in entry_points(group=group)]:
            try:
                plugin = point.load()()
                self.register(plugin)
                names.append(plugin.name)
            except Exception as e:  # whatever a package of someone else raises
                warnings.warn(f"plug-in {point.name} left out: {e}", stacklevel=2)
        return names

    def get(self, name: str) -> Plugin | None:
        return self.plugins.get(name)

    def parsers(self) -> list[dict]:
        """Types that plug-ins have added."""
        return [{k: getattr(p, k) for k in ("name", "version", "description")} for p in self.plugins.values() if isinstance(p, ParserPlugin)]

    def list(self) -> list[dict]:
        """Validators by ascending priority, equal ones in order of registration."""
        own = [p for p in self.plugins.values() if isinstance(p, ValidatorPlugin)]
        keys = ("name", "version", "description", "priority")
        return [{k: getattr(p, k) for k in keys} | {"enabled": self.enabled(p.name)} for p in sorted(own, key=lambda p: p.priority)]

    def enabled(self, name: str) -> bool:
        own = self.settings.get(name)
        default = getattr(self.plugins[name], "enabled_by_default", True)
        return bool(own.get("enabled", default)) if isinstance(own, dict) else default

    def config(self, name: str) -> dict:
        own = self.settings.get(name)
        return dict(own) if isinstance(own, dict) else {}

    def set_config(self, name: str, **values: object) -> None:
        if name not in self.plugins:
            raise KeyError(name)
        self.settings[name] = self.config(name) | values
        self.save()

    def set_enabled(self, name: str, enabled: bool) -> None:
        self.set_config(name, enabled=enabled)

    def save(self) -> None:
        text = json.dumps(self.settings, sort_keys=True, indent=2)
        if self.files is not None:
            self.files.put(self.path, text)
        elif self.path:
            new = f"{self.path}-{uuid.uuid4().hex}"
            Path(new).write_text(text, encoding="utf-8")
            os.replace(new, self.path)

    def run(self, table: DataFrame, isolate: bool = False) -> DataFrame:
        """Results of the enabled validators over files (path, text); see ``files.run_validators``."""
        own = [p.as_validator() for p in self.plugins.values() if isinstance(p, ValidatorPlugin) and self.enabled(p.name)]
        return files.run_validators(table, isolate=isolate, chosen=sorted(own, key=lambda v: v.priority))
