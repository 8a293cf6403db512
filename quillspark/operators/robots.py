"""Robots files: parsing, permission, delay."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=10_000)
def pattern(rule: str) -> str:
    """A rule's path as a regular expression: a prefix, ``*`` for anything, a closing ``$`` for the end."""
    end = rule.endswith("$")
    body = rule[:-1] if end else rule
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + ("$" if end else "")


@dataclass
class Group:
    agents: list[str]
    rules: list[tuple[str, str]] = field(default_factory=list)  # (allow or disallow, path)
    delay: float | None = None


@dataclass
class Robots:
    groups: list[Group] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str | None) -> "Robots":
        """Agent lines in a row share the rules behind them; an agent line after a rule starts a new group. An empty Disallow allows all."""
        out, now, ruled = cls(), Group([]), False
        for line in (text or "").splitlines():
            key, sep, value = line.split("#", 1)[0].strip().partition(":")
            key, value = key.strip().lower(), value.strip()
            if not sep:
                continue
            if key == "user-agent":
                if ruled and now.agents:
                    out.groups.append(now)
                    now, ruled = Group([]), False
                if value:
                    now.agents.append(value.lower())
            elif key in ("allow", "disallow"):
                ruled = True
                if value:
                    now.rules.append((key, value))
                elif key == "disallow":
                    now.rules.append(("allow", "/"))
            elif key == "crawl-delay":
                ruled = True
                if re.fullmatch(r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?", value, re.I):
                    now.delay = float(value)
            elif key == "sitemap" and value:
                out.sitemaps.append(value)
        if now.agents:
            out.groups.append(now)
        return out

    def _named(self, agent: str) -> Group | None:
        a = agent.lower()
        return next((g for g in self.groups if any(x in a or a in x for x in g.agents)), None)

    def _any(self) -> Group | None:
        return next((g for g in self.groups if "*" in g.agents), None)

    def allowed(self, agent: str, path: str) -> bool:
        """The longest matching rule decides, Allow wins ties; without a match or a group all is allowed."""
        group = self._named(agent) or self._any()
        hits = [(len(p.encode()), kind == "allow") for kind, p in (group.rules if group else ()) if re.search(pattern(p), path or "/", re.S)]
        return max(hits)[1] if hits else True

    def delay(self, agent: str) -> float | None:
        group = self._named(agent)
        if group is None or group.delay is None:
            group = self._any()
        return group.delay if group else None


@lru_cache(maxsize=1000)
def _parsed(text: str) -> Robots:
    return Robots.parse(text)


def allowed_udf(robots, agent: str, path) -> Column:
    """Whether a path is allowed by the robots file beside it; a null file allows all. Files are parsed once a worker."""
    def run(files: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([_parsed(f or "").allowed(agent, p or "/") for f, p in zip(files, paths)], dtype=bool)

    return F.pandas_udf(run, "boolean")(robots, path)


def delay_udf(robots, agent: str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([_parsed(f or "").delay(agent) for f in s], dtype=float), "double")(robots)


def allowed_by(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``allowed`` by one group's rules, as built-in functions: for many paths of one site."""
    tests = [F.when(F.col("path").rlike(f"(?s){pattern(p)}"), F.struct(F.lit(len(p.encode())).alias("n"), F.lit(kind == "allow").alias("ok"))) for kind, p in rules]
    best = F.array_max(F.filter(F.array(*tests), lambda x: x.isNotNull())) if tests else F.lit(None).cast("struct<n:int,ok:boolean>")
    return paths.withColumn("allowed", F.coalesce(best["ok"], F.lit(True)))
