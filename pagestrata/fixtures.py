"""Derived views over the driver tables; each statement runs in Spark SQL and in DuckDB alike."""

from __future__ import annotations

# Six variants of every page: plain, WordPress, Tilda, Bitrix, unknown, plain with content blocks.
SITE_PAGES = """
SELECT page_id, url,
  CASE page_id % 6
  WHEN 0 THEN html
  WHEN 1 THEN replace(replace(replace(bare,
      '<nav>', '<header class="site-header"><a class="logo" href="/"><img src="/wp-content/logo.png" alt="logo"></a><nav>'),
      '</nav>', '</nav><div class="contact">+7 (999) 123-45-67</div></header>'),
      '<footer>', '<footer><div class="widgets">w</div><div class="copyright">© 2024 X</div><ul class="social"><li><a href="https://s.example.com/1">s</a></li></ul>')
  WHEN 2 THEN replace(replace(replace(replace(bare,
      '<nav>', '<div id="t-header-1"><img class="t-logo__img" src="/t.png"><div class="t-menu__nav">'),
      '</nav>', '</div><div class="t-menu__phone-item">+7 (999) 123-45-67</div><a class="t-btn" href="/buy">Buy</a></div>'),
      '<footer>', '<div id="t-footer-1"><div class="t-copyright">© T</div><div class="t-info_address">Main st 1</div><footer>'),
      '</footer>', '</footer></div>')
  WHEN 3 THEN replace(replace(replace(replace(bare,
      '<head>', '<head><script src="/bitrix/js/main/core/core.js"></script>'),
      '<nav>', '<header><a class="logo" href="/home">L</a><nav>'),
      '</nav>', '</nav><span class="phone">+7 495 1234567</span><a href="/cart">c</a><a href="/login">in</a></header>'),
      '<footer>', '<footer><div class="contacts"><p>Main st 1</p></div><div class="social"><a href="https://s.example.com/2">s</a></div><a class="developer" href="https://dev.example.com">d</a>')
  WHEN 4 THEN bare
  ELSE replace(html, '<article>',
      '<header><a href="/"><img src="/logo.png"></a></header><section>' ||
      CASE CAST(floor(page_id / 6) AS BIGINT) % 8
        WHEN 0 THEN '<div>our swiper of things</div><h2>Slides to look through now</h2>'
        WHEN 1 THEN '<div>faq one two three four five six seven</div><b>answers</b>'
        WHEN 2 THEN '<img src="/a.png"><div>col-3 one two three four five six seven</div>'
        WHEN 3 THEN '<img src="/a.png"><button>Buy</button><div>some longer words go here</div>'
        WHEN 4 THEN '<b>plain words only, long enough to be kept as a block</b>'
        WHEN 5 THEN '<form><input name="q"></form><b>write to us any time that suits you, please</b>'
        WHEN 6 THEN '<b>call +79991234567 or write a@b.example.com at any hour</b>'
        ELSE '<b>tiny</b>' END
      || '</section><article>')
  END AS html
FROM (SELECT page_id, url, html,
        replace(replace(html, '<!DOCTYPE html>', ''), '<html lang', '<html data-l') AS bare
      FROM pages) p
"""

# A link graph over the pages: two links ahead, one to itself, links to skip, a foreign domain, dead pages.
CRAWL_PAGES = """
WITH k AS (
  SELECT page_id AS id,
    (2 * page_id + 1) % (SELECT count(*) FROM pages) AS a, (2 * page_id + 2) % (SELECT count(*) FROM pages) AS b
  FROM pages
), u AS (
  SELECT id, a, b,
    'https://h' || CAST(id % 4 AS STRING) || CASE WHEN id % 7 = 3 THEN '.example.org' ELSE '.example.com' END || '/p/' || CAST(id AS STRING) AS url,
    'https://h' || CAST(a % 4 AS STRING) || CASE WHEN a % 7 = 3 THEN '.example.org' ELSE '.example.com' END || '/p/' || CAST(a AS STRING) AS ua,
    'https://h' || CAST(b % 4 AS STRING) || CASE WHEN b % 7 = 3 THEN '.example.org' ELSE '.example.com' END || '/p/' || CAST(b AS STRING) AS ub
  FROM k
)
SELECT id AS page_id, url, CASE WHEN id % 11 = 10 THEN 404 ELSE 200 END AS status,
  '<!DOCTYPE html><html lang="en"><body>' ||
  '<a href="' || ua || '?q=1">a</a><a href="' || ub || '#frag">b</a>' ||
  '<a href="#top">t</a><a href="">e</a><a href="mailto:x@example.com">m</a><a href="/p/' || CAST(id AS STRING) || '">self</a>' ||
  '</body></html>' AS html
FROM u
"""

# Status events of jobs, taken from the event stream.
STATUS_LOG = """
SELECT user_id AS operation_id, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
    WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status
FROM events
"""
