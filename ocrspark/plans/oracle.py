"""SQL twins of the derived tables and registered queries (DuckDB dialect)."""

from __future__ import annotations

import re

from ocrspark import pins

# Named subqueries; each query gets those it mentions, directly or through others.
TABLES = {
    "ln": """select doc_id, lang, unnest(string_split(text, chr(10))) as line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 as par from documents""",
    "tk": """select doc_id, lang, par, unnest(string_split(line, ' ')) as text,
      generate_subscripts(string_split(line, ' '), 1) - 1 as tok from ln""",
    "tok": """select doc_id, lang, par, tok, text, length(text) as len,
      ((doc_id * 7 + par * 13 + tok * 29) % 100)::int as h from tk where text <> ''""",
    "otok": """select doc_id, lang, par, tok, len, h, (h * 31 + len * 3) % 101 as conf, copy,
      case when h < 5 then text || '~' when h < 8 then text || 'x'
        when h < 10 then translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
        else text end as text, h % 5 + copy * 48 as dx, copy * 10 as dy
      from (select *, 0 as copy from tok where h >= 3 union all select *, 1 from tok where h in (10, 11))""",
    "gtok": "select *, 100 as conf, 0 as copy, 0 as dx, 0 as dy from tok",
    "docs": r"""select doc_id, source || '_' || doc_id || case doc_id % 5 when 0 then '.hocr' when 1 then '.tar.gz'
        when 2 then '.pdf' when 3 then '' else '.extension' end as file_name,
      ((len(string_split(text, chr(10))) + 3) // 4)::int as page_count, doc_id % 2 = 0 as pdf_mode,
      doc_id % 3 = 0 as image_mode, doc_id % 5 < 3 as xml0,
      case doc_id % 4 when 0 then 'text' when 2 then 'ocr' end as pdf_type,
      [lang, 'eng', 'deu', 'fra'][1:doc_id % 5] as langs, lang from documents""",
    "pg": """select doc_id, page_no::int as page_no, (1200 + 100 * (page_no % 3))::int as width, 160000 as height
      from (select doc_id, unnest(range(page_count)) as page_no from docs)""",
    "lines": """select doc_id, page_no, line_no, par_no, min(l) as l, min(t) as t, max(r) as r, max(b) as b,
      ((par_no * 7 + doc_id) % 11 - 5) * 0.001e0 as slope, (-(par_no % 4))::int as "offset",
      (8 << (par_no % 3))::int as x_height from gt group by all""",
    "rp": "select doc_id, page_no from pg where doc_id % 3 = 0",
    "regions": """select doc_id, page_no, 'x0' as region_id, 0 as region_seq, 'exclude' as kind, null::int as ord,
        0 as l, 0 as t, 600 as r, 36 as b from rp
      union all select doc_id, page_no, 'o0', 1, 'order', (1 + doc_id % 5)::int, 0, 40000, 1200, 79999 from rp
      union all select doc_id, page_no, 'x1', 2, 'exclude', null, 0, 0, 1200, 16 from rp where page_no = 0
      union all select doc_id, page_no, 'o1', 3, 'order', 9, 0, 40000, 1200, 40400 from rp where page_no = 0""",
    "hits": """select a.doc_id, a.page_no, a.line_no, e.region_id, e.region_seq, e.kind, e.ord
      from lines a join regions e on a.doc_id = e.doc_id and a.page_no = e.page_no
      where OVERLAP(a, e) > 0.5""",
    "marks": """select doc_id, page_no, line_no, max_by(ord, region_seq) filter (kind = 'order') as ord,
      bool_or(kind = 'exclude') as excluded from hits group by all""",
    "cols": """select doc_id, 0 as page_no, 't0' as table_id,
      case when doc_id % 2 = 0 then 'majority' else 'left' end as rule,
      case when doc_id % 7 = 0 then 'line' else 'word' end as level, c as col_no,
      c * 400 as l, 80000 as t, c * 400 + 400 as r, 119999 as b
      from docs, (select unnest([0, 1, 2]) as c) where page_count > 0""",
    "cells": """select w.doc_id, w.page_no, w.line_no, w.word_no, w.text, c.table_id, c.col_no
      from gt w join lines n on w.doc_id = n.doc_id and w.page_no = n.page_no and w.line_no = n.line_no
      join cols c on w.doc_id = c.doc_id and w.page_no = c.page_no
      where case when level = 'word' and rule = 'majority' then OVERLAP(w, c) > 0.5
        when level = 'line' and rule = 'majority' then OVERLAP(n, c) > 0.5
        when level = 'word' then LEFTIN(w, c) else LEFTIN(n, c) end""",
    "annots": """select doc_id, page_no, line_no * 12 + word_no as annot_no, word_id,
      case when word_no <> 0 then doc_id || '-' || (par_no // 3) end as group_id, l, t, r, b,
      case h when 20 then '#ffff00' else '#00ffff' end as color, 0.5e0 as opacity,
      case when word_no % 2 = 0 then 'seen' end as comment from gt where h in (20, 21)""",
    "pairs": """select g.doc_id, g.page_no, g.line_no as gl, g.word_no as gw, o.line_no as ol, o.word_no as ow,
      OVERLAP(o, g) as ov from ocr o join gt g on o.doc_id = g.doc_id and o.page_no = g.page_no
      and o.l < g.r and g.l < o.r and o.t < g.b and g.t < o.b
      where OVERLAP(o, g) > 0.5""",
    "ranked": """select *,
      row_number() over (partition by doc_id, page_no, gl, gw order by ov desc, ol, ow) as rg,
      row_number() over (partition by doc_id, page_no, ol, ow order by ov desc, gl, gw) as ro from pairs""",
    "best": "select doc_id, page_no, gl, gw, ol, ow from ranked where rg = 1 and ro = 1",
    "al": """select b.doc_id, b.page_no, b.gl, b.gw, b.ol, b.ow, g.text as gt_text, o.text as ocr_text,
      g.conf as gt_conf, o.conf as ocr_conf, NORM(g.text) = NORM(o.text) as same,
      g.word_id as g_id, o.word_id as o_id, g.l as g_l, g.t as g_t, g.r as g_r, g.b as g_b,
      o.l as o_l, o.t as o_t, o.r as o_r, o.b as o_b from best b
      join gt g on g.doc_id = b.doc_id and g.page_no = b.page_no and g.line_no = b.gl and g.word_no = b.gw
      join ocr o on o.doc_id = b.doc_id and o.page_no = b.page_no and o.line_no = b.ol and o.word_no = b.ow""",
    "lone_gt": """select g.* from gt g anti join best b on g.doc_id = b.doc_id and g.page_no = b.page_no
      and g.line_no = b.gl and g.word_no = b.gw""",
    "lone_ocr": """select o.* from ocr o anti join best b on o.doc_id = b.doc_id and o.page_no = b.page_no
      and o.line_no = b.ol and o.word_no = b.ow""",
    "status": """select doc_id, page_no, gl as line_no, gw as word_no, gt_text, ocr_text, ocr_conf as conf,
        case when same then 'correct' else 'incorrect' end as status from al
      union all select doc_id, page_no, line_no, word_no, text, null, null, 'missed' from lone_gt
      union all select doc_id, page_no, line_no, word_no, null, text, conf, 'extra' from lone_ocr""",
    "stats": """select doc_id, page_no, count(*) filter (status <> 'extra') as total,
      count(*) filter (status = 'correct') as correct, count(*) filter (status = 'incorrect') as incorrect,
      count(*) filter (status = 'missed') as missed, count(*) filter (status = 'extra') as extra,
      count(*) filter (status = 'correct' and conf <= 85) as correct_low_conf,
      count(*) filter (status = 'incorrect' and conf > 85) as incorrect_high_conf
      from status group by doc_id, page_no""",
    "edits": """select doc_id, word_id, s + i as seq, field, value, delta from (
      select doc_id, word_id, SEQ as s, unnest(list_filter([
        case h % 5
          when 0 then {'i': 0, 'field': 'bold', 'value': case when word_no % 2 = 0 then 'true' else 'false' end, 'delta': null::double}
          when 1 then {'i': 0, 'field': 'italic', 'value': 'true', 'delta': null}
          when 2 then {'i': 0, 'field': 'font', 'value': 'Mono', 'delta': null}
          when 3 then {'i': 0, 'field': 'size', 'value': (8 + word_no)::varchar, 'delta': null}
          else {'i': 0, 'field': 'size', 'value': null, 'delta': case when word_no % 2 = 0 then 1e0 else -1e0 end} end,
        case h
          when 35 then {'i': 1, 'field': 'bold', 'value': 'false', 'delta': null}
          when 36 then {'i': 1, 'field': 'italic', 'value': 'false', 'delta': null}
          when 37 then {'i': 1, 'field': 'font', 'value': 'Slab', 'delta': null}
          when 38 then {'i': 1, 'field': 'size', 'value': null, 'delta': 1e0}
          when 39 then {'i': 1, 'field': 'size', 'value': '20', 'delta': null} end,
        case h when 39 then {'i': 2, 'field': 'size', 'value': null, 'delta': -1e0} end
      ], lambda x: x is not null), recursive := true)
      from gt where h between 30 and 39)""",
    "edited": """select g.*, f.value as v_font, b.value as v_bold, i.value as v_italic, z.value as v_size,
      (select sum(delta) from edits e where e.doc_id = g.doc_id and e.word_id = g.word_id and e.field = 'size'
        and e.value is null and (z.seq is null or e.seq > z.seq)) as step from gt g
      left join last_edit f on f.doc_id = g.doc_id and f.word_id = g.word_id and f.field = 'font'
      left join last_edit b on b.doc_id = g.doc_id and b.word_id = g.word_id and b.field = 'bold'
      left join last_edit i on i.doc_id = g.doc_id and i.word_id = g.word_id and i.field = 'italic'
      left join last_edit z on z.doc_id = g.doc_id and z.word_id = g.word_id and z.field = 'size'""",
    "last_edit": """select doc_id, word_id, field, value, seq from edits where value is not null
      qualify row_number() over (partition by doc_id, word_id, field order by seq desc) = 1""",
    "ops": """select doc_id, word_id, s + i as seq, op, color, opacity, comment from (
      select doc_id, word_id, SEQ as s, unnest(case h
        when 20 then [MARK(0, 'none', 0)]
        when 21 then [MARK(0, '#00ff00', 40), NOTE(1, 'check')]
        when 22 then [MARK(0, '#ff0000', 80), NOTE(1, 'first'), NOTE(2, 'second')]
        when 23 then [MARK(0, '#ff0000', 80), MARK(1, 'none', 80)]
        else [MARK(0, '#ff0000', 80), NOTE(1, 'lost'), MARK(2, 'none', 80), MARK(3, '#0000ff', 30)] end,
        recursive := true)
      from gt where h between 20 and 24 and (h <> 21 or word_no % 3 <> 0))""",
    "ag": """select doc_id, group_id, page_no, t as top, annot_no from annots where group_id is not null
      qualify row_number() over (partition by doc_id, group_id order by page_no, annot_no) = 1""",
    "idx": """select doc_id, group_id, page_no, top,
      row_number() over (partition by doc_id order by page_no, top, annot_no) as idx from ag""",
    "found": """select doc_id, page_no, count(*) filter (contains(lower(text), 'en')) as n from gt group by all""",
    "ch": """select doc_id, page_no, line_no, word_no, font, style, x_height, i, substring(text, i, 1) as ch,
      l + (i - 1) * step as l, t, l + (i - 1) * step + step - n % 3 as r, b - n % 5 as b
      from (select *, length(text) as n, (8 << (par_no % 3))::int as x_height,
        greatest((r - l) // length(text), 4)::int as step,
        case when bold then 'bold' when italic then 'italic' else 'normal' end as style,
        unnest(range(1, length(text) + 1)) as i from gt)""",
    "pars": """select doc_id, page_no, par_no, replace(replace(
        string_agg(text, chr(10) order by line_no), '-' || chr(10), ''), chr(10), ' ') as text
      from (select doc_id, page_no, par_no, line_no, string_agg(text, ' ' order by word_no) as text
        from gt group by all) group by all""",
    "rr": """select w.doc_id, w.page_no,
      dense_rank() over (partition by w.doc_id, w.page_no order by w.line_no) - 1 as line_no,
      row_number() over (partition by w.doc_id, w.page_no, w.line_no order by w.word_no) - 1 as word_no,
      word_id, text, conf, lang, font, bold, italic, small_caps, sup, underline, size, l, t, r, b from gt w""",
}

_WORDS = """select doc_id, (par // 4)::int as page_no, ((par % 4) * 2000 + tok // 12)::int as line_no,
  (tok % 12 + copy * 12)::int as word_no, par::int as par_no,
  case when copy = 0 then 'w' else 'x' end || par || '_' || tok as word_id, text, conf::int as conf,
  case when h % 20 = 0 then 'la' end as lang, lang as par_lang,
  case when h % 10 < 6 then 'Serif' when h % 10 < 9 then 'Sans' end as font,
  h % 7 = 0 as bold, h % 11 = 0 as italic, false as small_caps, false as sup, h % 13 = 0 as underline,
  (10 + h % 4)::double as size, ((tok % 12) * 100 + dx)::int as l,
  ((par % 4) * 40000 + (tok // 12) * 20 + dy)::int as t,
  ((tok % 12) * 100 + least(len * 8, 96) + dx)::int as r,
  ((par % 4) * 40000 + (tok // 12) * 20 + 16 + dy)::int as b, h from {}"""
TABLES["gt"] = _WORDS.format("gtok")
TABLES["ocr"] = _WORDS.format("otok")

_MACROS = {
    r"OVERLAP\((\w+), (\w+)\)": (
        r"(case when least(\1.r, \2.r) > greatest(\1.l, \2.l) and least(\1.b, \2.b) > greatest(\1.t, \2.t) "
        r"then (least(\1.r, \2.r) - greatest(\1.l, \2.l))::double * (least(\1.b, \2.b) - greatest(\1.t, \2.t))::double"
        r" / ((\1.r - \1.l)::double * (\1.b - \1.t)::double) else 0e0 end)"
    ),
    r"LEFTIN\((\w+), (\w+)\)": (
        r"(\1.l >= \2.l and \1.l < \2.r and (\1.t + \1.b) >= 2 * \2.t and (\1.t + \1.b) < 2 * \2.b)"
    ),
    r"NORM\(([\w.]+)\)": r"lower(regexp_replace(\1, '[\\p{P}\\p{S}]', '', 'g'))",
    r"\bSEQ\b": "(par_no::bigint * 1000000 + (line_no % 2000) * 120 + word_no * 10)",
    r"MARK\((\d), ('[^']*'), (\d+)\)": (
        r"{'i': \1, 'op': 'highlight', 'color': \2, 'opacity': \3::int, 'comment': null::varchar}"
    ),
    r"NOTE\((\d), ('[^']*')\)": (
        r"{'i': \1, 'op': 'comment', 'color': null::varchar, 'opacity': null::int, 'comment': \2}"
    ),
}


def _expand(sql: str) -> str:
    for pattern, text in _MACROS.items():
        sql = re.sub(pattern, text, sql)
    return sql


def query(sql: str) -> str:
    """A complete statement: the query with the named subqueries it needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"(?:from|join)\s+{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = _expand(sql)
    if not needed:
        return body
    # The word tables feed several branches; computing them once keeps the check quick.
    parts = [f"{n} as materialized ({_expand(TABLES[n])})" if n in ("gt", "ocr", "best", "edits", "last_edit")
             else f"{n} as ({_expand(TABLES[n])})" for n in needed]
    return "with " + ",\n".join(parts) + "\n" + body
