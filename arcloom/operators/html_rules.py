"""Which open HTML elements end where another begins, shared by the tag walkers.

These are the end tags that pages may leave out: an element ends if it lies
between the new one and the nearest element that keeps such rules inside.
"""

from __future__ import annotations

from collections.abc import Sequence

_CELLS = frozenset({"td", "th"})
_ROWS = frozenset({"tr"})
_SECTIONS = frozenset({"thead", "tbody", "tfoot"})
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template", "html", "select"})
_TABLE = frozenset({"table", "template", "html"})
_BLOCKS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"
).split()
FOREIGN = frozenset({"svg", "math"})

# tag -> (elements that end, elements that are not looked beyond)
_RULES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{tag: (frozenset({"p"}), _SCOPE) for tag in _BLOCKS},
    "li": (frozenset({"li", "p"}), _SCOPE | {"ul", "ol", "menu"}),
    "dt": (frozenset({"dt", "dd", "p"}), _SCOPE | {"dl"}),
    "dd": (frozenset({"dt", "dd", "p"}), _SCOPE | {"dl"}),
    "td": (_CELLS | {"p"}, _TABLE | _ROWS),
    "th": (_CELLS | {"p"}, _TABLE | _ROWS),
    "tr": (_CELLS | _ROWS | {"p"}, _TABLE | _SECTIONS),
    **{tag: (_CELLS | _ROWS | _SECTIONS | {"caption", "colgroup", "p"}, _TABLE) for tag in _SECTIONS},
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup", "template", "html"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "template", "html"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}


def implied_ends(open_tags: Sequence[str], tag: str) -> int:
    """How many of the innermost open elements end where ``tag`` begins."""
    rule = _RULES.get(tag)
    if rule is None:
        return 0
    ending, stops = rule
    n = 0
    for depth, name in enumerate(reversed(open_tags), 1):
        if name in stops:
            break
        if name in ending:
            n = depth
    return n


def closes_itself(open_tags: Sequence[str]) -> bool:
    """Whether ``<tag/>`` ends at once: only inside drawings and formulas, elsewhere the slash means nothing."""
    return any(t in FOREIGN for t in open_tags)
