"""Fields inside headers and footers.

Each function takes the name of a container column (see ``containers``) and
gives SQL for one field; a missing container gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagestrata import rules
from pagestrata.functions.chains import first_chain
from pagestrata.functions.text import quoted, sql_likely_phone, sql_trim, sql_valid_phone
from pagestrata.operators.dom import sql_let, sql_matches_any
from pagestrata.rules import Sel


def _hits(box: str, sels: Sequence[Sel], n: str = "n") -> str:
    """Nodes below the container that match; ancestors are looked up on the whole page."""
    return f"filter({box}.below, {n} -> {sql_matches_any(sels, n)})"


def _text(box: str, n: str) -> str:
    """Trimmed text of a node, cut from the container's text."""
    return sql_trim(f"CAST(substring({box}.text, {n}.text_start - {box}.text_start + 1, {n}.text_end - {n}.text_start) AS STRING)")


def _first(box: str, sels: Sequence[Sel]) -> str:
    return f"get({_hits(box, sels)}, 0)"


def _first_filled(arrays: Sequence[str]) -> str:
    return f"get(filter(array({', '.join(arrays)}), v -> size(v) > 0), 0)"


def _marked(text: str, marks: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(m)})" for m in marks) + ")"


def first_attribute(box: str, sels: Sequence[Sel], attribute: str) -> str:
    """Attribute of the first node in document order that matches any selector."""
    return f"{_first(box, sels)}.attrs[{quoted(attribute)}]"


def ordered_attribute(box: str, sels: Sequence[Sel], attribute: str) -> str:
    """Attribute of the first selector whose first node has it."""
    return "coalesce(" + ", ".join(first_attribute(box, [s], attribute) for s in sels) + ")"


def first_text(box: str, sels: Sequence[Sel]) -> str:
    return sql_let(_first(box, sels), "f", f"CASE WHEN f IS NOT NULL THEN {_text(box, 'f')} END")


def ordered_text(box: str, sels: Sequence[Sel], condition: str = "t <> ''") -> str:
    """Text of the first selector whose first node's text ``t`` meets the condition."""
    texts = ", ".join(first_text(box, [s]) for s in sels)
    return f"get(filter(array({texts}), t -> t IS NOT NULL AND {condition}), 0)"


def _anchors(box: str, hits: str) -> str:
    inside = "exists(hs, h -> a.node_id > h.node_id AND a.node_id <= h.last_desc_id)"
    return sql_let(hits, "hs", f"filter({box}.below, a -> a.tag = 'a' AND {inside})")


def _anchor_texts(box: str, hits: str) -> str:
    return f"filter(transform({_anchors(box, hits)}, k -> {_text(box, 'k')}), t -> t <> '')"


def first_menu(box: str, sels: Sequence[Sel]) -> str:
    """Link texts below the first node that matches any selector."""
    return _first_filled([_anchor_texts(box, f"slice({_hits(box, sels)}, 1, 1)")])


def ordered_menu(box: str, sels: Sequence[Sel]) -> str:
    """Link texts below the hits of the first selector that gives any."""
    return _first_filled([_anchor_texts(box, _hits(box, [s])) for s in sels])


def any_links(box: str, sels: Sequence[Sel]) -> str:
    """Link targets below any hit of any selector."""
    hrefs = f"transform({_anchors(box, _hits(box, sels))}, k -> k.attrs['href'])"
    return _first_filled([f"filter({hrefs}, u -> u IS NOT NULL)"])


def ordered_links(box: str, sels: Sequence[Sel]) -> str:
    """Non-empty link targets of the first selector that gives any."""
    hrefs = [f"transform({_anchors(box, _hits(box, [s]))}, k -> k.attrs['href'])" for s in sels]
    return _first_filled([f"filter({h}, u -> u <> '')" for h in hrefs])


def _per_hit(box: str, sel: Sel, tag_names: Sequence[str], value: str) -> str:
    """Values ``value`` of tags below each hit; nested hits count a node again."""
    names = ", ".join(quoted(t) for t in tag_names)
    below = f"filter({box}.below, k -> k.tag IN ({names}) AND k.node_id > h.node_id AND k.node_id <= h.last_desc_id)"
    return f"flatten(transform({_hits(box, [sel])}, h -> transform({below}, k -> {value})))"


def per_hit_texts(box: str, sels: Sequence[Sel], tag_names: Sequence[str]) -> str:
    return _first_filled([f"filter({_per_hit(box, s, tag_names, _text(box, 'k'))}, t -> t <> '')" for s in sels])


def per_hit_links(box: str, sels: Sequence[Sel]) -> str:
    values = [_per_hit(box, s, ("a",), "k.attrs['href']") for s in sels]
    return _first_filled([f"filter({v}, u -> u IS NOT NULL)" for v in values])


def present(box: str, sels: Sequence[Sel]) -> str:
    """True if any node matches, else null."""
    return f"CASE WHEN exists({box}.below, n -> {sql_matches_any(sels, 'n')}) THEN true END"


def last_marked_text(box: str, sels: Sequence[Sel], marks: Sequence[str]) -> str:
    """Last text with a copyright mark among the nodes that match any selector."""
    texts = f"filter(transform({_hits(box, sels)}, k -> {_text(box, 'k')}), t -> {_marked('t', marks)})"
    return sql_let(texts, "ts", "get(ts, size(ts) - 1)")


# -- fields by platform -----------------------------------------------------
# Names are in alphabetical order, the order of keys in the stored JSON.


def own_fields(box: str, wanted: dict[str, tuple[str, Sequence[Sel]]]) -> dict[str, str]:
    """Fields of a platform given as data: name to (kind, selectors).

    Kinds: ``text`` (first hit), ``menu`` (link texts), ``links`` (link targets), ``present``; any other kind is the attribute of that name.
    """
    readers = {"text": first_text, "menu": ordered_menu, "links": any_links, "present": present}
    found = {}
    for name in sorted(wanted):
        kind, sels = wanted[name]
        found[name] = readers[kind](box, sels) if kind in readers else ordered_attribute(box, sels, kind)
    return found


def html5_header(box: str) -> dict[str, str]:
    return {
        "contact": first_text(box, rules.HTML5_CONTACT),
        "logo": first_attribute(box, rules.HTML5_LOGO, "src"),
        "menu": first_menu(box, rules.HTML5_MENU),
    }


def html5_footer(box: str) -> dict[str, str]:
    fallback = last_marked_text(box, rules.tags("p", "div"), rules.COPYRIGHT_MARKS)
    return {
        "copyright": f"coalesce({first_text(box, rules.HTML5_COPYRIGHT)}, {fallback})",
        "social": any_links(box, rules.HTML5_SOCIAL),
    }


def tilda_header(box: str) -> dict[str, str]:
    buttons = ", ".join(sql_let(_first(box, [s]), "f", _button(box)) for s in rules.TILDA_BUTTON)
    return {
        "button": f"coalesce({buttons})",
        "logo": ordered_attribute(box, rules.TILDA_LOGO, "src"),
        "menu": ordered_menu(box, rules.TILDA_MENU),
        "phone": ordered_text(box, rules.TILDA_PHONE, sql_likely_phone("t")),
        "social": ordered_links(box, rules.TILDA_SOCIAL),
    }


def _button(box: str) -> str:
    text = _text(box, "f")
    return f"CASE WHEN {text} <> '' THEN named_struct('link', nullif(f.attrs['href'], ''), 'text', {text}) END"


def tilda_footer(box: str) -> dict[str, str]:
    fallback = last_marked_text(box, rules.tags("div", "p"), rules.COPYRIGHT_MARKS[:2])
    return {
        "contact": ordered_text(box, rules.TILDA_CONTACT),
        "copyright": f"coalesce({ordered_text(box, rules.TILDA_COPYRIGHT)}, {fallback})",
        "menu": ordered_menu(box, rules.TILDA_FOOTER_MENU),
        "social": ordered_links(box, rules.TILDA_SOCIAL),
    }


def bitrix_header(box: str) -> dict[str, str]:
    firsts = [_first(box, [s]) for s in rules.BITRIX_LOGO]
    owners = ", ".join(
        sql_let(f, "f", "CASE WHEN f.attrs['src'] IS NOT NULL OR f.attrs['href'] IS NOT NULL THEN f END") for f in firsts
    )
    phones = [f"transform({_hits(box, [s])}, k -> {_text(box, 'k')})" for s in rules.BITRIX_PHONES]
    return {
        "auth": present(box, rules.BITRIX_AUTH),
        "cart": present(box, rules.BITRIX_CART),
        "logo": f"coalesce({owners}).attrs['src']",
        "logo_link": sql_let(f"coalesce({owners})", "f", "CASE WHEN f.attrs['src'] IS NULL THEN f.attrs['href'] END"),
        "menu": ordered_menu(box, rules.BITRIX_MENU),
        "phones": _first_filled([f"filter({p}, t -> {sql_valid_phone('t')})" for p in phones]),
        "search": present(box, rules.BITRIX_SEARCH),
    }


def bitrix_footer(box: str) -> dict[str, str]:
    marked = ", ".join(last_marked_text(box, [s], rules.COPYRIGHT_MARKS) for s in rules.BITRIX_COPYRIGHT)
    return {
        "contacts": per_hit_texts(box, rules.BITRIX_CONTACTS, ("p", "div")),
        "copyright": f"coalesce({marked})",
        "developer": ordered_attribute(box, rules.BITRIX_DEVELOPER, "href"),
        "menu": ordered_menu(box, rules.BITRIX_FOOTER_MENU),
        "social": per_hit_links(box, rules.BITRIX_SOCIAL),
    }


def wordpress_header(fragment: Column) -> dict[str, Column]:
    """Fragments of the header; an absent one is an empty string."""
    return _fragments(
        fragment,
        contacts=rules.WORDPRESS_CONTACTS,
        logo=rules.WORDPRESS_LOGO,
        menu=rules.WORDPRESS_MENU,
        search=rules.WORDPRESS_SEARCH,
    )


def wordpress_footer(fragment: Column) -> dict[str, Column]:
    return _fragments(
        fragment,
        copyright=rules.WORDPRESS_COPYRIGHT,
        nav_links=rules.WORDPRESS_NAV_LINKS,
        social=rules.WORDPRESS_SOCIAL,
        widgets=rules.WORDPRESS_WIDGETS,
    )


def _fragments(fragment: Column, **chains) -> dict[str, Column]:
    return {
        name: F.when(fragment.isNotNull(), F.coalesce(first_chain(fragment, found), F.lit("")))
        for name, found in chains.items()
    }
