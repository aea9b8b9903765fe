"""A tangle of overlapping words is cut once for all its places."""

from ticktide.functions import segment as S


def test_equal_tangles_are_cut_once(monkeypatch):
    cut, seen = S._ends, []
    monkeypatch.setattr(S, "_ends", lambda tangle, nested: seen.append(tangle) or cut(tangle, nested))
    tree = S._Tree(["abc", "cd", "de", "xy"])
    assert S._cut(["abcd-xy" * 50, "abcde", "-"], tree) == [["abc", "d-", "xy"] * 50, ["abc", "de"], ["-"]]
    assert sorted(seen) == ["abcd", "abcde"]


def test_a_table_or_a_search_for_edges(monkeypatch):
    words, text = ["ab", "abc", "bca", "c"], "abcabbcacc" * 20
    whole = S._cut([text], S._Tree(words))
    monkeypatch.setattr(S, "CELLS", 0)
    assert S._cut([text], S._Tree(words)) == whole
