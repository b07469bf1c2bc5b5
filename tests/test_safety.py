"""Web addresses in prose, made from a grammar: what is one address and whether it is reserved follow from the parts that it is made of."""

import ipaddress
import itertools
import random

import pytest
from pyspark.sql import functions as F

from assay.functions import safety

LETTERS = "bcdfgkmnprstvz"


class Grammar:
    """Draws parts of addresses; a part comes with what it means."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choice(LETTERS) for _ in range(self.rng.randint(3, 7)))

    def scheme(self):
        plain = self.rng.choice(["http", "https"])
        return "".join(c.upper() if self.rng.random() < 0.2 else c for c in plain) + "://"

    def split_scheme(self):
        """A scheme with control characters between its letters."""
        out = list(self.scheme())
        for k in sorted(self.rng.sample(range(1, len(out)), 2), reverse=True):
            out.insert(k, self.rng.choice("\t\n\r"))
        return "".join(out)

    def user(self):
        return self.rng.choice(["", "", f"{self.word()}@", f"{self.word()}:{self.word()}@", f"{self.word()} {self.word()}@"])

    def reserved_host(self):
        network = ipaddress.ip_network(self.rng.choice(["10.0.0.0/8", "127.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "169.254.0.0/16"]))
        address = str(network[self.rng.randrange(1, network.num_addresses - 1)])
        local6 = f"[fe80::{self.rng.randrange(1, 0xFFFF):x}]"
        return self.rng.choice(["localhost", f"{self.word()}.localhost", f"{self.word()}.local", f"example.{self.rng.choice(['com', 'net', 'org', 'edu'])}", f"{self.word()}.{self.word()}.example.net", address, local6, "[::1]"])

    def open_host(self):
        reserved = self.rng.choice(["localhost", "example.com", f"{self.word()}.local"])
        public = ".".join(map(str, (self.rng.choice([8, 23, 93]), *(self.rng.randrange(1, 255) for _ in range(3)))))
        return self.rng.choice([f"{self.word()}.test", f"{self.word()}.{self.word()}.org", f"{reserved}.{self.word()}.test", f"{self.word()}{reserved.replace('.', '-')}", f"{self.word()}localhost", f"{self.word()}example.com", public, f"[2600::{self.rng.randrange(1, 999)}]"])

    def port(self):
        return self.rng.choice(["", "", f":{self.rng.randrange(1, 65535)}"])

    def path(self):
        w = self.word
        return self.rng.choice(["", "/", f"/{w()}", f"/{w()}/{w()}?{w()}={w()}", f"?{w()}", f"#{w()}", f"/{w()}@{w()}"])

    def address(self, reserved):
        host = self.reserved_host() if reserved else self.open_host()
        return self.scheme() + self.user() + host + self.port() + self.path()

    def around(self):
        """Text before and behind an address; what is behind ends it."""
        w = self.word
        return self.rng.choice([
            ("", ""), (f"{w()} ", f" {w()}"), (f"{w()}: ", f".\n\n{w().title()} {w()}"), ("(", f"), {w()}"), ("<", f"> {w()}"), ('"', f'" {w()}'), ("`", "`"), ("**", "**"), ("~~", f"~~ {w()}"), (f"{w()} '", f"', {w()}"), (f"{w()}, ", f"! {w()}"), ("", f"\n\n{w()}.test/x"),
        ])


def unsafe(text):
    return [t for t, authority in safety.url_tokens(text) if safety._is_unsafe(t, authority)]


@pytest.mark.parametrize("seed", range(300))
def test_addresses_in_prose(seed):
    g = Grammar(seed)
    for reserved in (True, False):
        address, (before, behind) = g.address(reserved), g.around()
        assert unsafe(before + address + behind) == ([] if reserved else [address]), (before, address, behind)


@pytest.mark.parametrize("seed", range(100))
def test_a_reserved_host_before_another_one(seed):
    """What looks like the host is user information, or goes on behind a character that no host may have."""
    g = Grammar(seed)
    first, second, path = g.reserved_host(), f"{g.word()}.test", f"/{g.word()}"
    for joint in ("@", " @", "\t@", "\\@", ":80@"):
        text = g.scheme() + first + joint + second + path
        assert unsafe(text) == [text], joint
    for joint in ("\t", "\n", "\r\n", "'", '"', ")", "`", "'" * 3000, "\t" * 3000, "\t'", "'\t"):
        text = g.scheme() + first + joint + "." + second + path
        assert unsafe(text) == [text], joint
    text = g.split_scheme() + second + path
    assert unsafe(text) == [text]


@pytest.mark.parametrize("seed", range(50))
def test_several_addresses(seed):
    g = Grammar(seed)
    parts = [(reserved, g.scheme() + (g.reserved_host() if reserved else g.open_host()) + f"/{g.word()}") for reserved in g.rng.choices([True, False], k=6)]
    for between in (" ", ", ", "\n\n", " and ", "> <", '" "'):
        assert unsafe(between.join(a for _, a in parts)) == [a for reserved, a in parts if not reserved]


def test_addresses_without_a_host():
    for text in ("https://", "http://?", "http://[::1", "http:///x", "http://.", "http://["):
        assert len(unsafe(text)) == 1


def test_brackets_and_long_texts():
    g = Grammar(7)
    one, two = g.scheme() + "example.org/" + g.word(), g.scheme() + g.word() + ".test/" + g.word()
    assert unsafe(f"[{two}].") == [two] and unsafe(f"[{one}]{two}") == [two] and unsafe(one + "]" * 9_000 + two) == [two]
    assert len(safety.url_tokens(one + (one + "/") * 3_000)) == 1
    assert unsafe(one + "\n" + "Next") == [] and unsafe("") == [] and safety.url_tokens("http:/ no") == []


def test_columns(spark):
    g = Grammar(3)
    rows = [(k, *pair) for k, pair in enumerate(itertools.product([None, "", "CVE-2099-7777", "cVe-1999-{0}", "Cve-2031-{0} and cve-2031-{0}"], [None, True, False]))]
    texts, want = [], {}
    for k, cve, reserved in rows:
        number, address = g.rng.randrange(1000, 99999), None if reserved is None else g.scheme() + (g.reserved_host() if reserved else f"{g.word()}.test") + "/p"
        text = None if cve is None and reserved is None else f"{(cve or '').format(number)} see {address or 'nothing'}, please"
        texts.append((k, text))
        found = sorted({x for x in (text or "").replace(",", " ").split() if x.lower().startswith("cve-") and "2099" not in x})
        want[k] = [("real_year_cve", x) for x in found] + ([("unsafe_url", address)] if reserved is False else [])
    df = spark.createDataFrame(texts, "id int, t string")
    assert {r["id"]: [(v["rule"], v["found"]) for v in r["v"]] for r in df.select("id", safety.violations(F.col("t")).alias("v")).collect()} == want
