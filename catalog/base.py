"""Inputs and shared SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagestrata import fixtures
from pagestrata.plans.parse import operations, page_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# -- inputs -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = fixtures.SITE_PAGES.replace("FROM pages", "FROM {pages}")
    return spark.sql(sql, pages=pages(spark, sf_dir))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = fixtures.CRAWL_PAGES.replace("FROM pages", "FROM {pages}")
    return spark.sql(sql, pages=pages(spark, sf_dir))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = fixtures.STATUS_LOG.replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


_AT = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})"


def at(seconds: str):
    """Time of a page's job: an input of the job, here derived from the page id."""
    return F.expr(_AT.format(seconds=seconds))


def site_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(site(spark, sf_dir), at("page_id"), at("page_id + 2"), "completed")


def site_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the site pages; each query parses anew."""
    return page_blocks(site(spark, sf_dir), at("page_id + 1"))


# -- SQL --------------------------------------------------------------------

SITE = f"site AS ({fixtures.SITE_PAGES})"
CRAWL = fixtures.CRAWL_PAGES.strip().removeprefix("WITH ")
STATUS = f"status_log AS ({fixtures.STATUS_LOG})"
OPS = """
ops AS (
  SELECT page_id, md5(url || '|' || CAST(page_id AS VARCHAR)) AS operation_id, url, 'completed' AS status,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id + 2) AS updated_at
  FROM site
)"""


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def json_object(**values: str) -> str:
    """DuckDB SQL of a JSON object without its null values; values are JSON or null."""
    parts = ", ".join(f"'\"{k}\":' || {v}" for k, v in values.items())
    return "'{' || concat_ws(',', " + parts + ") || '}'"


def json_text(value: str) -> str:
    return f"CAST(to_json(CAST({value} AS VARCHAR)) AS VARCHAR)"


def json_list(value: str) -> str:
    return f"CASE WHEN len({value}) > 0 THEN CAST(to_json({value}) AS VARCHAR) END"


# The seeded templates in match order, (id, priority, label, steps); each step holds if one of its options occurs.
TEMPLATES = (
    (2, 0, "Карта", (("map",),)),
    (5, 0, "Карточка товара", (("tovar",),)),
    (6, 0, "Контакты", (("contacts",),)),
    (7, 0, "Партнеры", (("partners",),)),
    (8, 0, "Поиск", (("find",),)),
    (10, 0, "Таблица", (("table",),)),
    (18, 0, "Карусель, слайд шоу с текстом", (("swiper",), ("<p", "<h",),)),
    (11, 1, "Таймлайн", (("timeline",),)),
    (17, 1, "Товары", (("products",),)),
    (19, 1, "FAQ", (("faq",),)),
    (20, 1, "Форма обратной связи", (("mailto:tel:",),)),
    (21, 1, "Карусель, слайд шоу", (("swiper",),)),
    (9, 3, "Смешанный контент", (("<p", "<h",), ("<button", "<a",),)),
    (1, 4, "Блок с картинкой 3 колонки", (("<img",), ("col-3",),)),
    (3, 4, "Картинка + Действие", (("<img",), ("<button", "<a",),)),
    (13, 4, "Текстовый блок", (("<p", "<h",),)),
    (16, 4, "Текст блок + Картинка", (("<p", "<h",), ("<img",),)),
    (4, 5, "Картинка+текст", (("<img",), ("<p", "<h",),)),
    (12, 5, "Текст + Действие", (("<p", "<h",), ("<button", "<a",),)),
    (14, 5, "Текстовый блок 2 колонки", (("<p", "<h",), ("col-2",),)),
    (15, 5, "Попап, виджет", (("popup", "onclick",),)),
    (22, 5, "Блок с картинкой", (("<img",),)),
)

# Markers by platform.
MARKERS = {
    "html5": ("<!DOCTYPE html>", "<html lang", '<meta charset="UTF-8">',),
    "wordpress": ("wp-content", "wp-includes", "wp-json", '<meta name="generator" content="WordPress', 'class="wordpress"', "/wp-admin/", "/wp-login.php",),
    "tilda": ("tilda.ws", "tildacdn.com", '<meta name="generator" content="Tilda', "data-tilda", "t-body", "t-page", "t-records", "t-rec", 'class="t', 'id="t',),
    "bitrix": ("bitrix/js", "bitrix/templates", '<meta name="generator" content="Bitrix', "BX\\.", "b24-widget", 'class="bx-', 'id="bx_', "<!-- Bitrix", "1C-Bitrix", "/bitrix/",),
}


def template_case(html: str, value: str = "label") -> str:
    """DuckDB CASE of the seeded templates in match order."""
    cases = []
    for number, _, label, steps in TEMPLATES:
        tests = " AND ".join("(" + " OR ".join(f"contains({html}, {sql_string(o)})" for o in step) + ")" for step in steps)
        cases.append(f"WHEN {tests} THEN {sql_string(label) if value == 'label' else number}")
    return "CASE " + " ".join(cases) + " END"


# Markers of the platforms and of the Bitrix generations.
PLATFORM = """CASE
  WHEN contains(html, '<!DOCTYPE html>') OR contains(html, '<html lang') OR contains(html, '<meta charset="UTF-8">') THEN 'html5'
  WHEN regexp_matches(html, 'wp-content|wp-includes|wp-json|<meta name="generator" content="WordPress|class="wordpress"|/wp-admin/|/wp-login\\.php') THEN 'wordpress'
  WHEN regexp_matches(html, 'tilda\\.ws|tildacdn\\.com|<meta name="generator" content="Tilda|data-tilda|t-body|t-page|t-records|t-rec|class="t|id="t') THEN 'tilda'
  WHEN regexp_matches(html, 'bitrix/js|bitrix/templates|<meta name="generator" content="Bitrix|BX\\\\\\.|b24-widget|class="bx-|id="bx_|<!-- Bitrix|1C-Bitrix|/bitrix/') THEN 'bitrix'
  ELSE 'unknown' END"""
BITRIX_VERSION = """CASE WHEN regexp_matches(html, 'BX24\\.|b24-') THEN 'modern'
  WHEN regexp_matches(html, 'bitrix/js/main/core/core') THEN 'legacy'
  WHEN regexp_matches(html, 'bitrix/components/bitrix') THEN 'old' ELSE 'unknown' END"""

# Facts cut from the regular markup of the site pages.  ``ob`` / ``cb`` are the bold
# elements a page leaves open (at most three of equal form are opened again).
FACTS = f"""
facts AS (
  SELECT page_id, url, html, {PLATFORM} AS platform,
    regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav,
    replace(replace(regexp_extract(html, '(?s)<footer>.*?(&copy;[^<]*)</footer>', 1), '&copy;', '©'), '&middot;', '·') AS foot_text,
    repeat('<b>', CAST(least(3, (length(html) - length(replace(html, '<p><b>', ''))) // 6) AS INTEGER)) AS ob,
    repeat('</b>', CAST(least(3, (length(html) - length(replace(html, '<p><b>', ''))) // 6) AS INTEGER)) AS cb,
    contains(html, '<header') AS has_header,
    regexp_replace(regexp_extract(html, '(?s)<header[^>]*>(.*?)</header>', 1), '<(img|input)([^>]*)>', '<\\1\\2/>', 'g') AS header_inner,
    regexp_replace(regexp_extract(html, '(?s)<div id="t-header-1">(.*?<a class="t-btn" href="/buy">Buy</a>)</div>', 1), '<(img|input)([^>]*)>', '<\\1\\2/>', 'g') AS tilda_header,
    regexp_extract(html, '(?s)<div class="t-menu__nav">(.*?)</div>', 1) AS tilda_nav,
    regexp_extract(html, '(?s)<section>(.*?)</section>', 1) AS section_raw
  FROM site
), shaped AS (
  SELECT *,
    list_transform(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1), lambda t: replace(t, '&amp;', '&')) AS nav_items,
    list_transform(regexp_extract_all(tilda_nav, '<a [^>]*>([^<]*)</a>', 1), lambda t: replace(t, '&amp;', '&')) AS tilda_items,
    CASE
      WHEN contains(html, '<div class="widgets">') THEN '<div class="widgets">' || ob || 'w' || cb || '</div><div class="copyright">' || ob || '© 2024 X' || cb
        || '</div><ul class="social"><li>' || ob || '<a href="https://s.example.com/1">s</a>' || cb || '</li></ul>' || ob || foot_text || cb
      WHEN contains(html, '<div class="contacts">') THEN '<div class="contacts"><p>' || ob || 'Main st 1' || cb || '</p></div><div class="social">' || ob
        || '<a href="https://s.example.com/2">s</a>' || cb || '</div>' || ob || '<a class="developer" href="https://dev.example.com">d</a>' || foot_text || cb
      ELSE ob || foot_text || cb END AS footer_inner,
    '<div class="t-copyright">' || ob || '© T' || cb || '</div><div class="t-info_address">' || ob || 'Main st 1' || cb || '</div><footer>' || ob || foot_text || cb || '</footer>' AS tilda_footer,
    regexp_replace(section_raw, '<(img|input)([^>]*)>', '<\\1\\2/>', 'g') AS section_html,
    regexp_replace(section_raw, '<[^>]*>', '', 'g') AS section_text,
    contains(section_raw, '<img') AS section_image
  FROM facts
), sections AS (
  SELECT page_id, section_html, section_text, section_image,
    {template_case('section_html')} AS template,
    {template_case('section_html', 'id')} AS template_id,
    CASE WHEN contains(section_html, '<form') THEN 'Форма обратной связи'
      WHEN regexp_matches(section_text, '\\+\\d{{1,3}}\\s*\\(\\d{{3,}}\\)\\s*\\d{{3,}}|\\+\\d{{10,}}|\\d{{3,}}[\\s-]?\\d{{3,}}[\\s-]?\\d{{2,}}|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 'Контакты'
      WHEN section_image AND contains(section_html, '<button') THEN 'Картинка + Действие'
      WHEN section_image THEN 'Блок с картинкой'
      WHEN contains(section_html, '<h2') THEN 'Текстовый блок'
      ELSE 'Смешанный контент' END AS heuristic
  FROM shaped WHERE section_raw <> ''
), kept AS (
  SELECT * FROM sections
  WHERE (strlen(trim(section_text)) >= 30 OR section_image) AND (strlen(section_html) >= 50 OR section_image)
)"""

# The original fragment patterns, which DuckDB's engine runs in linear time.
_WP = {
    "header": "(?s)<header.*?>(.*?)</header>",
    "logo1": '(?s)<a.*?class=".*?logo.*?".*?>(.*?)</a>',
    "logo3": '(?s)<a.*?><img.*?src=".*?".*?></a>',
    "menu1": "(?s)<nav.*?>(.*?)</nav>",
    "menu2": '(?s)<(?:div|ul)\\s+class=".*?(?:menu|navigation).*?".*?>(.*?)</(?:div|ul)>',
    "contacts": '(?s)<div\\s+class=".*?(?:contact|phone|email|address).*?".*?>(.*?)</div>',
    "search": '(?s)<form.*?(?:class=".*?search.*?".*?|id=".*?search.*?".*?)>(.*?)</form>',
    "header2": '(?s)<div\\s+(?:class=".*?header.*?".*?|id=".*?header.*?".*?)>(.*?)</div>',
    "footer": "(?s)<footer.*?>(.*?)</footer>",
    "footer2": '(?s)<div\\s+(?:class=".*?footer.*?".*?|id=".*?footer.*?".*?)>(.*?)</div>',
    "widgets1": '(?s)<div\\s+class=".*?widgets.*?".*?>(.*?)</div>',
    "widgets2": '(?s)<div\\s+class=".*?sidebar.*?".*?>(.*?)</div>',
    "copyright1": '(?s)<div\\s+class=".*?copyright.*?".*?>(.*?)</div>',
    "copyright2": "(?s)(?:©|&copy;).*?\\d{4}",
    "social1": '(?s)<div\\s+class=".*?social.*?".*?>(.*?)</div>',
    "social2": '(?s)<ul\\s+class=".*?(?:social|socials).*?".*?>(.*?)</ul>',
    "nav1": '(?s)<nav\\s+class=".*?footer-navigation.*?".*?>(.*?)</nav>',
    "nav2": '(?s)<ul\\s+class=".*?footer-menu.*?".*?>(.*?)</ul>',
}


def wp(column: str, *patterns: str) -> str:
    """First pattern that matches, or an empty string."""
    tries = [f"nullif(regexp_extract({column}, {sql_string(_WP[p])}), '')" for p in patterns]
    return f"coalesce({', '.join(tries)}, '')"


WORDPRESS = f"""
wp_header AS (
  SELECT page_id, html, {wp('h', 'logo1', 'logo3')} AS logo, {wp('h', 'menu1', 'menu2')} AS menu,
    {wp('h', 'contacts')} AS contacts, {wp('h', 'search')} AS search
  FROM (SELECT page_id, {wp('html', 'header', 'header2')} AS h, {wp('html', 'header', 'header2')} AS html FROM wp_pages) WHERE h <> ''
), wp_footer AS (
  SELECT page_id, html, {wp('h', 'widgets1', 'widgets2')} AS widgets, {wp('h', 'copyright1', 'copyright2')} AS copyright,
    {wp('h', 'social1', 'social2')} AS social, {wp('h', 'nav1', 'nav2')} AS nav_links
  FROM (SELECT page_id, {wp('html', 'footer', 'footer2')} AS h, {wp('html', 'footer', 'footer2')} AS html FROM wp_pages) WHERE h <> ''
)"""

_TRUE = "'true'"
BLOCKS = f"""
{SITE}, {FACTS}, wp_pages AS (SELECT page_id, html FROM facts WHERE platform = 'wordpress'), {WORDPRESS},
parts AS (
  SELECT page_id, 'wordpress' AS platform, 'header' AS block_type, 0 AS ord,
    {json_object(contacts=json_text('contacts'), logo=json_text('logo'), menu=json_text('menu'), search=json_text('search'))} AS content, html
  FROM wp_header
  UNION ALL
  SELECT page_id, 'wordpress', 'footer', 9,
    {json_object(copyright=json_text('copyright'), nav_links=json_text('nav_links'), social=json_text('social'), widgets=json_text('widgets'))}, html
  FROM wp_footer
  UNION ALL
  SELECT page_id, 'tilda', 'header', 0,
    {json_object(button="'{\"link\":\"/buy\",\"text\":\"Buy\"}'", logo=json_text("'/t.png'"), menu=json_list('tilda_items'), phone=json_text("'+7 (999) 123-45-67'"))},
    tilda_header
  FROM shaped WHERE platform = 'tilda'
  UNION ALL
  SELECT page_id, 'tilda', 'footer', 9, {json_object(contact=json_text("'Main st 1'"), copyright=json_text("'© T'"))}, tilda_footer
  FROM shaped WHERE platform = 'tilda'
  UNION ALL
  SELECT page_id, 'bitrix', 'header', 0,
    {json_object(auth=_TRUE, cart=_TRUE, logo_link=json_text("'/home'"), menu=json_list('nav_items'), phones=json_list("['+7 495 1234567']"), version=json_text(BITRIX_VERSION))},
    header_inner
  FROM shaped WHERE platform = 'bitrix'
  UNION ALL
  SELECT page_id, 'bitrix', 'footer', 9,
    {json_object(contacts=json_list("['Main st 1']"), developer=json_text("'https://dev.example.com'"), social=json_list("['https://s.example.com/2']"), version=json_text(BITRIX_VERSION))},
    footer_inner
  FROM shaped WHERE platform = 'bitrix'
  UNION ALL
  SELECT page_id, 'html5', 'header', 0, {json_object(logo=json_text("regexp_extract(header_inner, 'img src=\"([^\"]*)\"', 1)"))}, header_inner
  FROM shaped WHERE platform = 'html5' AND has_header
  UNION ALL
  SELECT page_id, 'html5', 'content', 1,
    {json_object(matched_pattern="CASE WHEN template IS NULL THEN 'false' ELSE 'true' END", template_name=json_text('coalesce(template, heuristic)'))},
    section_html
  FROM kept
  UNION ALL
  SELECT page_id, 'html5', 'footer', 9, '{{}}', footer_inner FROM shaped WHERE platform = 'html5'
), {OPS}, blocks AS (
  SELECT page_id, operation_id, md5(operation_id || '|' || CAST(position AS VARCHAR)) AS block_id, block_type, platform,
    position, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS block_no, content, html,
    created_at + to_seconds(1) AS created_at
  FROM (
    SELECT p.*, o.operation_id, o.created_at,
      CASE WHEN ord = 9 THEN 1 + count(*) FILTER (block_type = 'content') OVER (PARTITION BY p.page_id) ELSE ord END AS position
    FROM parts p JOIN ops o USING (page_id)
  )
)"""


def over_blocks(select: str) -> str:
    return f"WITH {BLOCKS} {select}"
