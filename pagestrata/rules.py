"""Rule data: markers, selectors, templates, labels.

Everything here is plain data.  A user adds a platform or a rule by passing
longer lists to the operators; no code changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple


class Sel(NamedTuple):
    """One selector: a tag, attribute tests, and at most one relation.

    ``tests`` holds ``(attribute, operator, value)``; operators are ``has``,
    ``=``, ``^=`` (starts with), ``*=`` (contains) and ``~=`` (has the class).
    ``under`` / ``child_of`` name an ancestor / the parent, ``holding`` a
    descendant, ``text`` a case-insensitive part of the node's text.
    """

    tag: str | None = None
    tests: tuple[tuple[str, str, str | None], ...] = ()
    under: "Sel | None" = None
    child_of: "Sel | None" = None
    holding: "Sel | None" = None
    text: str | None = None


def on(tag: str | None = None, *tests: tuple[str, str, str | None], **relation) -> Sel:
    return Sel(tag, tests, **relation)


def cls(name: str) -> tuple[str, str, str]:
    return ("class", "~=", name)


def ident(name: str) -> tuple[str, str, str]:
    return ("id", "=", name)


def classes(*names: str) -> list[Sel]:
    return [on(None, cls(n)) for n in names]


def tags(*names: str) -> list[Sel]:
    return [on(n) for n in names]


class Template(NamedTuple):
    """Label rule: every step must hold; a step holds when one of its options occurs."""

    template_id: int
    label: str
    priority: int
    steps: tuple[tuple[str, ...], ...]


PLATFORMS = ("html5", "wordpress", "tilda", "bitrix")
STATUSES = ("pending", "processing", "completed", "error")
BLOCK_TYPES = ("header", "footer", "content")

@dataclass(frozen=True)
class OwnPlatform:
    """A platform given as data: markers, selectors of its header and footer, and fields of each, name to (kind, selectors)."""

    markers: tuple[str, ...]
    containers: dict[str, list[Sel]]
    fields: dict[str, dict[str, tuple[str, list[Sel]]]]


# Substrings that identify a platform.
MARKERS: dict[str, tuple[str, ...]] = {
    "html5": ("<!DOCTYPE html>", "<html lang", '<meta charset="UTF-8">'),
    "wordpress": (
        "wp-content", "wp-includes", "wp-json", '<meta name="generator" content="WordPress',
        'class="wordpress"', "/wp-admin/", "/wp-login.php",
    ),
    "tilda": (
        "tilda.ws", "tildacdn.com", '<meta name="generator" content="Tilda', "data-tilda",
        "t-body", "t-page", "t-records", "t-rec", 'class="t', 'id="t',
    ),
    "bitrix": (
        "bitrix/js", "bitrix/templates", '<meta name="generator" content="Bitrix', "BX\\.", "b24-widget",
        'class="bx-', 'id="bx_', "<!-- Bitrix", "1C-Bitrix", "/bitrix/",
    ),
}

# Patterns of Bitrix generations; the first that matches is reported.
BITRIX_VERSIONS: tuple[tuple[str, str], ...] = (
    ("modern", r"BX24\.|b24-"),
    ("legacy", r"bitrix/js/main/core/core"),
    ("old", r"bitrix/components/bitrix"),
)


# Container selectors in order of preference.
def _generic_container(part: str, role: str) -> list[Sel]:
    return [
        on(part),
        on("div", cls(part)),
        on("div", ident(part)),
        on(None, cls(f"site-{part}")),
        on(None, ident(f"site-{part}")),
        on("div", ("role", "=", role)),
        on(None, cls(f"main-{part}")),
        on(None, ident(f"main-{part}")),
    ]


def _tilda_container(part: str, record_types: tuple[str, ...]) -> list[Sel]:
    return [
        on("div", ("id", "^=", f"t-{part}")),
        *[on("div", ("data-record-type", "=", t)) for t in record_types],
        on("div", cls(f"t-site-{part}-wrapper")),
        on(None, cls("t396__elem"), cls(part)),
    ]


CONTAINERS: dict[tuple[str, str], list[Sel]] = {
    ("html5", "header"): _generic_container("header", "banner"),
    ("html5", "footer"): _generic_container("footer", "contentinfo"),
    ("bitrix", "header"): _generic_container("header", "banner"),
    ("bitrix", "footer"): _generic_container("footer", "contentinfo"),
    ("tilda", "header"): _tilda_container("header", ("257", "258", "396")),
    ("tilda", "footer"): _tilda_container("footer", ("56", "106", "331")),
}
TILDA_RECORD = on("div", ("id", "^=", "rec"))
# Content candidates are dropped below these footers; the list is shorter than the footer selectors.
EXCLUDED_FOOTERS = CONTAINERS["html5", "footer"][:5]

_TEXT_ELEMENT = (cls("tn-elem"), ("data-elem-type", "=", "text"))

# Field selectors.
HTML5_LOGO = [on("img", under=on("a")), *classes("logo", "site-logo"), on(None, ident("logo"))]
HTML5_MENU = [on("nav"), *classes("navigation", "menu"), on("ul", cls("menu"))]
HTML5_CONTACT = classes("contact", "phone", "email")
HTML5_COPYRIGHT = classes("copyright", "site-info")
HTML5_SOCIAL = classes("social", "social-links", "socials")

TILDA_LOGO = [
    *classes("t-logo", "t-logo__img"),
    on("img", ("imgfield", "=", "img")),
    on("img", under=on("a", cls("t-menu__logo-wrapper"))),
]
TILDA_MENU = [*classes("t-menu__nav", "t-menu__nav-item"), on("a", under=on(None, *_TEXT_ELEMENT))]
TILDA_PHONE = [*classes("t-menu__phone-item", "t-info_phone"), on(None, *_TEXT_ELEMENT, text="+")]
TILDA_SOCIAL = classes("t-sociallinks", "t-sociallinks__item")
TILDA_BUTTON = [
    *classes("t-btn"),
    on("a", ("href", "has", None), holding=on(None, cls("t-btn"))),
    on(None, cls("tn-atom"), cls("t-btn")),
]
TILDA_COPYRIGHT = [
    *classes("t-copyright", "t-footer_inlined-copyright"),
    on(None, cls("tn-elem"), text="©"),
    on(None, cls("tn-elem"), text="copyright"),
]
TILDA_CONTACT = [
    *classes("t-footer_address", "t-info_address"),
    on(None, cls("tn-elem"), text="contact"),
    on(None, cls("tn-elem"), text="адрес"),
]
TILDA_FOOTER_MENU = classes("t-footer_menu", "t-footer__nav-item")

BITRIX_LOGO = [*classes("logo", "site-logo"), on(None, ident("logo")), on("img", under=on("a"))]
BITRIX_MENU = [on("nav"), *classes("navigation", "menu"), on("ul", cls("menu"))]
BITRIX_SEARCH = [on("form", ("role", "=", "search")), *classes("search-form"), on("input", ("type", "=", "search"))]
BITRIX_PHONES = [*classes("phone", "contact-phone"), on("a", ("href", "^=", "tel:"))]
BITRIX_CART = [*classes("cart", "shopping-cart"), on("a", ("href", "*=", "cart"))]
BITRIX_AUTH = [*classes("login", "auth"), on("a", ("href", "*=", "login")), on("a", ("href", "*=", "auth"))]
BITRIX_COPYRIGHT = [*classes("copyright", "site-info"), *tags("p", "div")]
BITRIX_FOOTER_MENU = [on("nav"), *classes("footer-menu"), on("ul", cls("menu"))]
BITRIX_CONTACTS = classes("contacts", "footer-contacts", "address")
BITRIX_SOCIAL = classes("social", "social-links", "socials")
BITRIX_DEVELOPER = [*classes("developer", "developed-by"), on("a", ("href", "*=", "developer"))]

# Candidates for content blocks.
CANDIDATES = [
    on("section"),
    on("div", cls("section")),
    on("div", ("class", "*=", "section")),
    on("div", ("class", "*=", "block")),
    on("div", ("class", "*=", "container")),
    on("div", cls("content")),
    on("div", child_of=on("main")),
]


def _class_part(*parts: str) -> list[Sel]:
    return [on(None, ("class", "*=", p)) for p in parts]


# Features of the heuristic classifier.
FEATURES: dict[str, list[Sel]] = {
    "images": tags("img"),
    "buttons": [on("button"), on("a", cls("btn")), *classes("button"), *_class_part("btn-")],
    "headings": tags("h1", "h2", "h3", "h4", "h5", "h6"),
    "paragraphs": tags("p"),
    "forms": tags("form"),
    "tables": tags("table"),
    "maps": [*_class_part("map"), on("iframe", ("src", "*=", "map"))],
    "contacts": [*_class_part("contact"), on(None, ("id", "*=", "contact"))],
    "products": [*_class_part("product", "item"), *classes("card")],
    "sliders": _class_part("slider", "carousel", "swiper"),
    "faqs": [*_class_part("faq", "accordion"), *classes("collapse")],
    "columns_2": _class_part("col-2", "column-2", "grid-2", "row", "flex", "grid"),
    "columns_3": _class_part("col-3", "column-3", "grid-3", "row", "flex", "grid"),
}

# Labels the heuristic classifier can give.
LABEL_MAP = "Карта"
LABEL_FORM = "Форма обратной связи"
LABEL_CONTACTS = "Контакты"
LABEL_FAQ = "FAQ"
LABEL_TABLE = "Таблица"
LABEL_SLIDER_TEXT = "Карусель, слайд шоу с текстом"
LABEL_SLIDER = "Карусель, слайд шоу"
LABEL_PRODUCTS = "Товары"
LABEL_IMAGE_ACTION = "Картинка + Действие"
LABEL_TEXT_IMAGE = "Текст блок + Картинка"
LABEL_TEXT_ACTION = "Текст + Действие"
LABEL_IMAGE_COLUMNS = "Блок с картинкой 3 колонки"
LABEL_IMAGE = "Блок с картинкой"
LABEL_TEXT_COLUMNS = "Текстовый блок 2 колонки"
LABEL_TEXT = "Текстовый блок"
LABEL_MIXED = "Смешанный контент"

# Phone and mail patterns of the contact test.
PHONE_PATTERNS = (
    r"\+\d{1,3}\s*\(\d{3,}\)\s*\d{3,}",
    r"\+\d{10,}",
    r"\d{3,}[\s-]?\d{3,}[\s-]?\d{2,}",
)
MAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# Marks of a copyright line.
COPYRIGHT_MARKS = ("©", "&copy;", "Copyright")

# Seeded template rows, (id, label, JSON rule) as they are stored.
TEMPLATE_SEED: tuple[tuple[int, str, str], ...] = (
    (1, "Блок с картинкой 3 колонки", '{"priority": 4, "step1": "<img", "step2": "col-3"}'),
    (2, "Карта", '{"priority": 0, "step1": "map"}'),
    (3, "Картинка + Действие", '{"priority": 4, "step1": "<img", "step2": "<button|<a"}'),
    (4, "Картинка+текст", '{"priority": 5, "step1": "<img", "step2": "<p|<h"}'),
    (5, "Карточка товара", '{"priority": 0, "step1": "tovar"}'),
    (6, "Контакты", '{"priority": 0, "step1": "contacts"}'),
    (7, "Партнеры", '{"priority": 0, "step1": "partners"}'),
    (8, "Поиск", '{"priority": 0, "step1": "find"}'),
    (9, "Смешанный контент", '{"priority": 3, "step1": "<p|<h", "step2": "<button|<a"}'),
    (10, "Таблица", '{"priority": 0, "step1": "table"}'),
    (11, "Таймлайн", '{"priority": 1, "step1": "timeline"}'),
    (12, "Текст + Действие", '{"priority": 5, "step1": "<p|<h", "step2": "<button|<a"}'),
    (13, "Текстовый блок", '{"priority": 4, "step1": "<p|<h"}'),
    (14, "Текстовый блок 2 колонки", '{"priority": 5, "step1": "<p|<h", "step2": "col-2"}'),
    (15, "Попап, виджет", '{"priority": 5, "step1": "popup|onclick"}'),
    (16, "Текст блок + Картинка", '{"priority": 4, "step1": "<p|<h", "step2": "<img"}'),
    (17, "Товары", '{"priority": 1, "step1": "products"}'),
    (18, "Карусель, слайд шоу с текстом", '{"priority": 0, "step1": "swiper", "step2": "<p|<h"}'),
    (19, "FAQ", '{"priority": 1, "step1": "faq"}'),
    (20, "Форма обратной связи", '{"priority": 1, "step1": "mailto:tel:"}'),
    (21, "Карусель, слайд шоу", '{"priority": 1, "step1": "swiper"}'),
    (22, "Блок с картинкой", '{"priority": 5, "step1": "<img"}'),
)

# Token chains of the WordPress and Tilda fragments (see functions.chains).
WORDPRESS_HEADER = [
    (r"<header", ">", "</header>"),
    (r'<div\s+(?:class|id)="', "header", '"', ">", "</div>"),
]
WORDPRESS_LOGO = [
    ("<a", 'class="', "logo", '"', ">", "</a>"),
    ("<a", "><img", 'src="', '"', "></a>"),
]
WORDPRESS_MENU = [
    ("<nav", ">", "</nav>"),
    (r'<(?:div|ul)\s+class="', "(?:menu|navigation)", '"', ">", "</(?:div|ul)>"),
]
WORDPRESS_CONTACTS = [(r'<div\s+class="', "(?:contact|phone|email|address)", '"', ">", "</div>")]
WORDPRESS_SEARCH = [("<form", '(?:class|id)="', "search", '"', ">", "</form>")]
WORDPRESS_FOOTER = [
    (r"<footer", ">", "</footer>"),
    (r'<div\s+(?:class|id)="', "footer", '"', ">", "</div>"),
]
WORDPRESS_WIDGETS = [
    (r'<div\s+class="', "widgets", '"', ">", "</div>"),
    (r'<div\s+class="', "sidebar", '"', ">", "</div>"),
]
WORDPRESS_COPYRIGHT = [
    (r'<div\s+class="', "copyright", '"', ">", "</div>"),
    ("(?:©|&copy;)", r"\d{4}"),
]
WORDPRESS_SOCIAL = [
    (r'<div\s+class="', "social", '"', ">", "</div>"),
    (r'<ul\s+class="', "social", '"', ">", "</ul>"),
]
WORDPRESS_NAV_LINKS = [
    (r'<nav\s+class="', "footer-navigation", '"', ">", "</nav>"),
    (r'<ul\s+class="', "footer-menu", '"', ">", "</ul>"),
]
TILDA_HEADER_FALLBACK = [
    (r'<div\s+class="', "(?:t-header|tn-header)", '"', ">", "</div>"),
    (r'<div\s+id="', "header", '"', ">", "</div>"),
]
TILDA_FOOTER_FALLBACK = [
    (r'<div\s+class="', "(?:t-footer|tn-footer)", '"', ">", "</div>"),
    (r'<div\s+id="', "footer", '"', ">", "</div>"),
]

# Crawl defaults.
DEFAULT_CRAWL_DELAY_SECONDS = 1
