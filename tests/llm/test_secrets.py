"""Secret scans against the plain patterns, and what the battery finds and leaves."""

import random
import re
import string

import pytest

pytest.importorskip("lodestar.llm")
from lodestar.llm import html_text, secrets  # noqa: E402

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(7)
    parts = ["password", "SECRET", "api_key", "ApiKey", "token", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "deadbeef", "0123456789abcdef", "é", "\n", "x", "-", "_", "/", "ABCDEFGH", "KK", "ſecret"]
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randrange(1, 25)))
        assert [s for s in secrets.scan(text) if s[0] != "random"] == plain(text)


@pytest.mark.parametrize(("alphabet", "n", "least"), [
    (string.ascii_letters + string.digits, 32, 0.9), (string.ascii_letters + string.digits + "+/", 40, 0.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 48, 0.8), (string.ascii_lowercase, 80, 0.6), (string.ascii_uppercase, 80, 0.6),
])
def test_random_tokens_of_each_alphabet_are_found(alphabet, n, least):
    draw = random.Random(n)
    hits = sum(any(s[0] == "random" for s in secrets.scan("see " + "".join(draw.choices(alphabet, k=n)) + " there")) for _ in range(100))
    assert hits >= 100 * least


@pytest.mark.parametrize("word", [
    "internationalizationalization", "my_very_long_identifier_name_here", "getElementsByClassNameAndAttribute", "AbstractSingletonProxyFactoryBean", "donaudampfschifffahrtsgesellschaftskapitaen",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789", "path/to/some/article-name-2024", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "ABABABABABABABABABABABABABABABAB",
])
def test_names_and_even_sequences_are_left(word):
    assert [s for s in secrets.scan(f"see {word} there") if s[0] == "random"] == []


def test_many_spans_in_one_text_end_in_time():
    text = " ".join(f"{i:016x}" for i in range(20_000)) + " " + "Q7zT2LmX9vB4kR8sW1nC6yH3dF5g"
    assert len(secrets.scan(text)) == 20_001


def test_what_text_is_called_does_not_make_it_furniture():
    page = '<body><nav>menu items</nav><article><h2 id="discussion">Discussion of all the results</h2><p class="notice-of-award">The award was given to many people</p><div class="ad">buy this now</div><p>More text follows here today</p><div id="comments"><p>nice post friend</p></div></article></body>'
    assert html_text.main_text(page, {}) == "Discussion of all the results\nThe award was given to many people\nMore text follows here today"


def test_deep_and_broken_pages_end_in_time():
    assert html_text.main_text("<div>" * 30_000 + "some words stand here" + "</div>" * 30_000, {}) == "some words stand here"
    assert html_text.main_text("<div>some words</p></x>" * 20_000, {})
