"""Registries of analysers: which function reads the files of a language, and which framework a manifest tells."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import basename

Analyser = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Analysers by language; of several for one language the last registered counts."""

    _by_name: dict[str, tuple[tuple[str, ...], Analyser]] = field(default_factory=dict)

    def register(self, name: str, languages: tuple[str, ...], analyser: Analyser) -> None:
        self._by_name.pop(name, None)
        self._by_name[name] = (languages, analyser)

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def for_language(self, language: str) -> Analyser | None:
        return next((a for langs, a in reversed(self._by_name.values()) if language in langs), None)

    def languages(self) -> list[str]:
        return sorted({x for langs, _ in self._by_name.values() for x in langs})

    def analyse(self, files: DataFrame) -> DataFrame | None:
        """Entities of all files (with column lang) that an analyser is registered for, one plan per analyser."""
        out = None
        for lang in self.languages():
            part = self.for_language(lang)(files.where(F.col("lang") == lang))
            out = part if out is None else out.unionByName(part)
        return out


def configured(text: str | None, names: list[str]) -> list[str]:
    """Names switched on by a configuration ``{"plugins": [{"name": ..., "enabled": ...}]}``; all of them where it is missing or broken."""
    try:
        plugins = json.loads(text or "")["plugins"]
        off = {p["name"] for p in plugins if not p.get("enabled", True)}
    except (ValueError, KeyError, TypeError):
        return list(names)
    return [n for n in names if n not in off]


def frameworks(files: DataFrame, table: list[tuple[str, str, str]]) -> DataFrame:
    """graphId, framework: frameworks of which a manifest holds the keyword. table: framework, manifest name, keyword; the first row of a framework and manifest counts."""
    known = F.broadcast(files.sparkSession.createDataFrame(table, "framework string, manifest string, keyword string"))
    f = files.where("content is not null").select("graphId", basename(F.col("path")).alias("manifest"), F.lower("content").alias("text"))
    return f.join(known, "manifest").where(F.contains("text", F.lower("keyword"))).select("graphId", "framework").distinct()
