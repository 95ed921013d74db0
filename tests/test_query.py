import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsearch.plans.query import STOP_WORDS, All, Any, Phrase, QuerySyntaxError, Without, Word, parse, ranking_leaves, terms_of, tokenize

A, B, C, D = map(Word, ("apple", "banana", "cherry", "date1"))


@pytest.mark.parametrize("text, tree", [
    ("apple", A), ("Apple BANANA", All((A, B))), ("apple AND banana", All((A, B))), ("apple OR banana", Any((A, B))), ("apple | banana || cherry", Any((A, B, C))),
    ("apple banana OR cherry", Any((All((A, B)), C))), ("apple NOT banana cherry", Without(A, (B, C))), ("apple NOT banana OR cherry", Any((Without(A, (B,)), C))),
    ('"apple banana"', Phrase(("apple", "banana"))), ("'of the' cherry", All((Phrase(("of", "the")), C))), ('"apple"', A),
    ("(apple OR banana) AND cherry", All((Any((A, B)), C))), ("apple (banana OR cherry)", All((A, Any((B, C))))), ("apple NOT (banana cherry)", Without(A, (All((B, C)),))),
    ("the apple of", A), ("the of", Word("the")), ("THE", Word("the")), ("apple-pie.", Word("applepie")), ("app'le banana", All((A, B))),
])
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "  ", "NOT apple", "apple AND", "OR apple", '"apple', "(apple", "apple OR", "()", '""', "apple AND ()"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_compat():
    assert parse('apple "banana"', compat=True) == A
    for text in ('"apple banana"', "(apple)", "apple OR (banana)"):
        with pytest.raises(QuerySyntaxError):
            parse(text, compat=True)


def test_terms():
    tree = parse('apple banana NOT cherry OR "date1 apple"')
    assert list(terms_of(tree, False)) == ["apple", "banana", "date1", "apple"]
    assert ranking_leaves(tree) == [["apple", "banana"], ["date1", "apple"]]
    assert ranking_leaves(tree, negative=True) == [["apple", "banana"], ["cherry"], ["date1", "apple"]]
    assert len(STOP_WORDS) == 551


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab AND OR NOT()\"'|&-", max_size=30))
def test_never_crashes(text):
    try:
        assert list(terms_of(parse(text)))
    except QuerySyntaxError:
        pass
    tokenize(text, compat=True)
