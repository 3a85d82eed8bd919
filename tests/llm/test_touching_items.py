"""Items of one kind that stand side by side stay apart."""

import pytest

from scorewise.llm import pii_crf as P


class Given:
    """A field that labels every word with a digit or @ as one kind."""
    splits = False
    emit = P.default_field().emit

    def __init__(self, label):
        self.label = label

    def viterbi(self, emits):
        return [[self.label] * len(e) for e in emits]


@pytest.mark.parametrize("label, text, want", [
    (4, "212-555-0187 +1 (202) 555-0147", [("212-555-0187", False), ("+1 (202) 555-0147", True)]),
    (4, "212-555-0187, 212-555-0188", [("212-555-0187", False), ("212-555-0188", False)]),
    (4, "(212) 555-0187 (212) 555-0188", [("(212) 555-0187", False), ("(212) 555-0188", False)]),
    (1, "a@localhost b@x.org c@intranet", [("a@localhost", False), ("b@x.org", True), ("c@intranet", False)]),
    (4, "555 0187 +1 (202) 555-0147", [("555 0187", False), ("+1 (202) 555-0147", True)]),
    (2, "10.0.0.1:8080", [("10.0.0.1", True)])])
def test_neighbours_stay_apart(label, text, want):
    assert [(text[s:e], base) for s, _, e, base in P.all_spans(Given(label), [text])[0]] == want


def test_the_trained_field_finds_both_numbers():
    text = "call 212-555-0187 +1 (202) 555-0147 now"
    assert "212-555-0187" in [text[s:e] for s, _, e, _ in P.all_spans(P.default_field(), [text])[0]]
