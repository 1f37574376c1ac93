"""Texts with labelled personal information, for measuring precision and recall by kind.

``python tests/llm/labelled.py`` prints the figures. Names, phrases and forms are the author's own; they
were written after the operator and not looked at while it was changed.
"""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

GIVEN = "Tom Jane Miguel Aisha Priya Lars Chloé Wei Fatima Oskar Nadia Pedro Hanna Kofi Elena Ravi Marta Diego Sofia Igor".split()
FAMILY = "Becker Smith Torres Rahman Nair Lindqvist Dubois Zhang Haddad Novak Petrov Silva Meyer Mensah Rossi Iyer Kowalska Fuentes Olsen Volkov".split()
HOSTS = "corp.example mail.example.org lab.test example.net uni.example".split()
PLACES = "Springfield Harrow Lindau Brook Verden Ashford".split()
NO_NAME = ["Binary Search", "Hash Table", "Red Black Tree", "Apache License", "Visual Studio", "Getting Started", "Release Notes", "Unit Tests", "Open Source", "Code Review"]


class Maker:
    """Builds one text from pieces, keeping where the labelled ones lie."""

    def __init__(self, rng: random.Random):
        self.rng, self.text, self.spans = rng, "", []

    def put(self, template: str, **values) -> None:
        for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
            if not piece.startswith("{"):
                self.text += piece
                continue
            kind, value = values[piece[1:-1]]
            if kind:
                self.spans.append((kind, len(self.text), len(self.text) + len(value)))
            self.text += value


def document(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    m = Maker(rng)
    for _ in range(rng.randrange(3, 9)):
        g, f = rng.choice(GIVEN), rng.choice(FAMILY)
        name = ("name", rng.choice([f"{g} {f}", f"{g} {f}", f"{g[0]}. {f}", f"{g} {rng.choice('ABKM')}. {f}"]))
        mail = ("email", rng.choice(["{}.{}@{}", "{}_{}@{}", "{}{} at {}"]).format(g.lower().replace("é", "e"), f.lower(), rng.choice(HOSTS)) if rng.random() < 0.85 else f"{f.lower()} [at] {rng.choice(HOSTS).replace('.', ' [dot] ')}")
        if " at " in mail[1]:
            mail = ("email", mail[1].replace(" at ", "@"))
        d = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
        phone = ("phone", rng.choice([f"+44 20 {d(4)} {d(4)}", f"(415) 555-{d(4)}", f"+49 {d(3)} {d(7)}", f"555 867 {d(4)}", f"1 800 555 {d(4)}", f"010-6{d(7)}", f"212-555-{d(4)}"]))
        number = ("idnum", rng.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"9{d(8)}"]))
        street = rng.choice([f"{rng.randrange(1, 999)} {f} Street", f"{rng.randrange(1, 999)} Old {f} Road", f"{rng.randrange(1, 99)} {f} Avenue"])
        town = rng.choice([f", {rng.choice(PLACES)}, CA 9{d(4)}", f", {rng.choice(PLACES)} 9{d(4)}", ""])
        address = ("address", street + town) if rng.random() < 0.7 else ("address", f"{f}straße {rng.randrange(1, 99)}" + rng.choice([f", {d(5)} {rng.choice(PLACES)}", ""]))
        other = (None, rng.choice(NO_NAME))
        rng.choice([
            lambda: m.put("// patch contributed by {n} <{e}>\n", n=name, e=mail),
            lambda: m.put("// patch contributed by {n}\n", n=name),
            lambda: m.put("# Implemented by {n}\n", n=name),
            lambda: m.put("# Implemented by {n} ({e})\n", n=name, e=mail),
            lambda: m.put("Kontakt: {n}, {p}\n", n=name, p=phone),
            lambda: m.put("Best regards,\n{n}\n", n=name),
            lambda: m.put("phone: {p}\n", p=phone),
            lambda: m.put("call {p} for support\n", p=phone),
            lambda: m.put("mail {e} about {o}\n", e=mail, o=other),
            lambda: m.put("ssn: {i}\n", i=number),
            lambda: m.put("insurance number {i} of {n}\n", i=number, n=name),
            lambda: m.put("ships to {a}\n", a=address),
            lambda: m.put("{n}, {a}\n", n=name, a=address),
            lambda: m.put("The {o} chapter explains {o}.\n", o=other),
            lambda: m.put("see {o} of 2024-03-11 at rev 1.24.3, build 20240311-1, id {u}\n", o=other, u=(None, f"{d(8)}-b1c2-4d3e-8f90-{d(12)}")),
            lambda: m.put("timeout = {u}\nclass FastQueue extends BaseQueue // Quick Win\n", u=(None, d(9))),
        ])()
    return m.text, m.spans


def corpus(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rng = random.Random(seed)
    return [document(rng) for _ in range(n)]


def measure(spark, n: int) -> dict[str, tuple[int, int, int]]:
    """Labelled, found, and both, by kind; a place counts if both its ends are right."""
    from keystrata.llm.privacy import find_personal

    texts = corpus(n)
    found = find_personal(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")).collect()
    want = {(i, *s) for i, (_, spans) in enumerate(texts) for s in spans}
    got = {(r.doc_id, r.kind, r.start_char, r.end_char) for r in found}
    counts = [Counter(x[1] for x in s) for s in (want, got, want & got)]
    return {k: tuple(c[k] for c in counts) for k in ("email", "phone", "idnum", "address", "name")}


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    for kind, (want, got, both) in measure(session, 2000).items():
        print(f"{kind}: {want} labelled, recall {both / want:.3f}, precision {both / max(1, got):.3f}")
