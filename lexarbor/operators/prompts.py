"""Prompts from a template: each field is drawn from its pool, by seed and key. Pools and templates are parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarbor.operators import sampling


@dataclass
class Prompt:
    """A template with {names}; a name is a uniform choice, `k` different members joined by commas, or a whole number."""

    template: str
    choices: dict[str, list[str]] = field(default_factory=dict)
    several: dict[str, tuple[list[str], int]] = field(default_factory=dict)
    numbers: dict[str, tuple[int, int]] = field(default_factory=dict)

    def column(self, seed: int, key: Column) -> Column:
        drawn = {n: sampling.choice(p, f"{seed}-{n}", key) for n, p in self.choices.items()}
        drawn |= {n: F.array_join(sampling.choose(p, k, f"{seed}-{n}", key), ", ") for n, (p, k) in self.several.items()}
        drawn |= {n: sampling.whole_number(a, b, f"{seed}-{n}", key).cast("string") for n, (a, b) in self.numbers.items()}
        out = F.lit(self.template)
        for name, value in drawn.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out


@dataclass
class Several:
    """k different members of a pool, joined."""

    pool: list[str]
    k: int
    between: str = ", "


@dataclass
class Number:
    """A whole number from low to high, times unit."""

    low: int
    high: int
    unit: int = 1


@dataclass
class When:
    """A text that depends on what another field was drawn: the text for that very alternative, or else the other one."""

    of: str
    texts: dict[str, str]
    otherwise: str = ""


@dataclass
class Grammar:
    """A template whose {names} are fields: a list of alternatives, Several, Number or When. Alternatives and texts are templates, too.

    A field is drawn once for a key, wherever it stands. Fields that lead back to themselves are an error.
    """

    template: str
    fields: dict[str, list[str] | Several | Number | When] = field(default_factory=dict)

    def column(self, seed: int, key: Column) -> Column:
        return self._text(self.template, seed, key, ())

    def _text(self, template: str, seed: int, key: Column, inside: tuple[str, ...]) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        out = [self._field(p, seed, key, inside) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
        return F.concat(*out) if out else F.lit("")

    def _drawn(self, name: str, seed: int, key: Column) -> Column:
        """The number of a field's alternative, from 0."""
        return F.floor(sampling.uniform(f"{seed}-{name}", key) * len(self.fields[name]))

    def _field(self, name: str, seed: int, key: Column, inside: tuple[str, ...]) -> Column:
        if name in inside:
            raise ValueError(f"{name} leads back to itself")
        rule, inside, draw = self.fields[name], (*inside, name), f"{seed}-{name}"
        if isinstance(rule, Several):
            return F.array_join(sampling.choose(rule.pool, rule.k, draw, key), rule.between)
        if isinstance(rule, Number):
            return (sampling.whole_number(rule.low, rule.high, draw, key) * rule.unit).cast("string")
        at, texts, other = (self._drawn(name, seed, key), dict(enumerate(rule)), None) if isinstance(rule, list) else (self._drawn(rule.of, seed, key), {self.fields[rule.of].index(v): t for v, t in rule.texts.items()}, rule.otherwise)
        last = max(texts) if other is None else None
        out = self._text(texts[last] if other is None else other, seed, key, inside)
        for i, text in texts.items():
            if i != last:
                out = F.when(at == i, self._text(text, seed, key, inside)).otherwise(out)
        return out


CITIES = ["Lisbon", "Oslo", "Riga", "Turin", "Ghent", "Porto", "Graz", "Tartu"]
TOPICS = ["databases", "compilers", "robotics", "testing", "security", "data engineering", "design systems"]
TONES = ["dry", "friendly", "sceptical", "excited", "formal"]
LENGTHS = ["two sentences", "a short paragraph", "three paragraphs"]

PROMPTS = {
    "single": Prompt("Announce one {topic} event in {city}, for {seats} people, in a {tone} tone and {length}.", {"topic": TOPICS, "city": CITIES, "tone": TONES, "length": LENGTHS}, {}, {"seats": (20, 400)}),
    "listing": Prompt("List {count} events about {topic} in {cities}, in a {tone} tone and {length}.", {"topic": TOPICS, "tone": TONES, "length": LENGTHS}, {"cities": (CITIES, 3)}, {"count": (3, 6)}),
    "junk": Prompt("Write a post about {topic} that announces no event, in a {tone} tone and {length}.", {"topic": TOPICS, "tone": TONES, "length": LENGTHS}),
}


#: An announcement with a speaker, a place that may be online, and a price that has a second sentence only where there is one.
ANNOUNCEMENT = Grammar(
    "{who} on {topic}, {where}. {price}{contact}",
    {
        "who": ["{speaker} speaks", "An evening with {speaker}", "{count} talks, one by {speaker},"],
        "speaker": ["{first} {last}", "Dr {last}"],
        "first": ["Ada", "Bruno", "Chiara", "Dmitri", "Elif", "Femi"],
        "last": ["Ahlgren", "Bianchi", "Costa", "Duarte", "Eriksen", "Fischer", "Grau"],
        "topic": TOPICS,
        "where": ["in {cities}", "online", "in {city} and online"],
        "city": CITIES,
        "cities": Several(CITIES, 2, " and "),
        "count": Number(2, 9),
        "admission": ["free", "ticket", "invited"],
        "amount": Number(3, 40, 5),
        "price": When("admission", {"free": "Entry is free.", "ticket": "A ticket is {amount} euros, {seats}."}, "By invitation."),
        "seats": ["of which there are {number}", "and seats are few"],
        "number": Number(20, 400),
        "contact": When("where", {"online": " The link comes by mail."}),
    },
)


def generate(rows: DataFrame, key: str, label: str, seed: int, prompts: dict[str, Prompt] | None = None) -> DataFrame:
    """rows with the prompt of their label; null for labels without one."""
    out = F.lit(None).cast("string")
    for name, p in (prompts or PROMPTS).items():
        out = F.when(F.col(label) == name, p.column(seed, F.col(key))).otherwise(out)
    return rows.withColumn("prompt", out)
