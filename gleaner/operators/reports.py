"""Reports as text: Markdown, article HTML, digest HTML lines, chat cards, export rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import paragraphs
from gleaner.operators.health import percent

SUMMARY_TOP, MAX_ELEMENTS = 10, 20


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def fill(template: str, **columns: Column) -> Column:
    """A template with {names} as one concat of literals and columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def when_text(text: Column, shown: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", shown).otherwise("")


def mapped(arr: Column, each: Callable[[Column], Column], sep: str = "") -> Column:
    return F.array_join(F.transform(arr, each), sep)


def markdown(title, source, date, summary, keywords, labels, body, link) -> Column:
    """An article as a Markdown document; empty parts leave no heading."""
    ticks = lambda arr: mapped(arr, lambda k: F.concat(F.lit("`"), k, F.lit("`")), " ")
    section = lambda head, text, present: F.when(present, F.concat(F.lit(f"## {head}\n\n"), text, F.lit("\n\n"))).otherwise("")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    meta = F.array_join(
        F.filter(
            F.array(F.when(filled(source), F.concat(F.lit("来源："), source)), F.when(filled(date), F.concat(F.lit("日期："), date))),
            lambda m: m.isNotNull(),
        ),
        " ｜ ",
    )
    text = F.concat(
        F.lit("# "), title, F.lit("\n\n"),
        when_text(meta, F.concat(F.lit("> "), meta, F.lit("\n"))), F.lit("\n"),
        section("AI 摘要", summary, filled(summary)),
        section("关键词", ticks(keywords), F.size(keywords) > 0),
        section("分类", ticks(labels), F.size(labels) > 0),
        F.lit("---\n\n"),
        mapped(paragraphs(body), lambda p: F.concat(p, F.lit("\n\n"))),
    )
    # without a link the document ends after one line break
    return F.when(filled(link), F.concat(text, F.lit("---\n\n原文链接："), link)).otherwise(F.regexp_replace(text, r"\n\z", ""))


@dataclass(frozen=True)
class Look:
    """The parts of an article template. ``{x}`` marks where the text goes."""

    title: str
    meta: str
    rule: str
    summary: str
    paragraph: str
    keyword: str
    end: str
    link: str
    foot: str
    closing: str


# The two article templates.
LOOKS = {
    "green-simple": Look(
        title='<p style="text-align:center;font-size:17px;font-weight:bold;color:#2e7d32;line-height:1.6;margin:10px 0 4px;">{x}</p>',
        meta='<p style="text-align:center;font-size:13px;color:#999;margin:0 0 6px;">{x}</p>',
        rule='<div style="width:50px;height:2px;background:#2e7d32;margin:0 auto 16px;"></div>',
        summary='<div style="background:#e8f5e9;border-radius:6px;padding:12px 16px;margin:0 0 16px;font-size:14px;color:#333;line-height:1.7;"><span style="font-weight:bold;color:#2e7d32;">📖 摘要</span><br>{x}</div>',
        paragraph='<p style="font-size:15px;line-height:1.75;color:#333;margin:0 0 12px;text-align:justify;">{x}</p>',
        keyword='<span style="display:inline-block;padding:2px 10px;margin:0 6px 6px 0;font-size:12px;color:#2e7d32;border:1px solid #2e7d32;border-radius:12px;">{x}</span>',
        end='<hr style="border:none;border-top:1px solid #eee;margin:20px 0 10px;">',
        link='<a href="{x}" style="color:#2e7d32;text-decoration:none;">阅读原文</a> · ',
        foot='<p style="text-align:center;font-size:12px;color:#bbb;margin:6px 0;">{x}</p>',
        closing='<span style="color:#bbb;">{x}</span>',
    ),
    "clean-white": Look(
        title='<p style="text-align:center;font-size:18px;font-weight:bold;color:#111;line-height:1.6;margin:12px 0 4px;">{x}</p>',
        meta='<p style="text-align:center;font-size:12px;color:#aaa;margin:0 0 6px;">{x}</p>',
        rule='<hr style="border:none;border-top:1px solid #e8e8e8;margin:0 0 20px;">',
        summary='<div style="border-left:3px solid #ccc;padding:8px 14px;margin:0 0 20px;font-size:14px;color:#666;line-height:1.7;">{x}</div>',
        paragraph='<p style="font-size:16px;line-height:1.8;color:#444;margin:0 0 14px;text-align:justify;">{x}</p>',
        keyword='<span style="display:inline-block;padding:2px 8px;margin:0 4px 4px 0;font-size:12px;color:#666;background:#f5f5f5;border-radius:3px;">{x}</span>',
        end='<hr style="border:none;border-top:1px solid #e8e8e8;margin:20px 0 10px;">',
        link='<a href="{x}" style="color:#999;text-decoration:none;">阅读原文</a> · ',
        foot='<p style="text-align:center;font-size:11px;color:#ccc;margin:6px 0;">{x}</p>',
        closing='<span style="color:#ccc;">{x}</span>',
    ),
}
KEYWORD_BOX = '<div style="margin:16px 0 0;">{x}</div>'
DOCUMENT = (
    '<!DOCTYPE html>\n<html lang="zh-CN">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n'
    '<title>{title}</title>\n<base target="_blank">\n</head>\n<body style="margin:0;padding:0;background:#f5f5f5;">\n'
    '<div style="max-width:640px;margin:0 auto;background:#fff;min-height:100vh;padding:10px 16px 40px;box-sizing:border-box;">\n{body}\n</div>\n</body>\n</html>'
)


def article_html(look: str, title, source, date, summary, keywords, body, link, signature: str = "自动排版") -> Column:
    """An article as an HTML fragment in one of the named looks."""
    if look not in LOOKS:
        raise ValueError(f"unknown look {look!r}, one of {sorted(LOOKS)}")
    s = LOOKS[look]
    put = lambda template, x: fill(template, x=x)
    meta = escape(F.array_join(F.filter(F.array(source, date), lambda m: F.coalesce(m, F.lit("")) != ""), " · "))
    words = mapped(keywords, lambda k: put(s.keyword, escape(k)))
    lines = mapped(paragraphs(body), lambda p: put(s.paragraph, F.replace(escape(p), F.lit("\n"), F.lit("<br>"))))
    return F.concat(
        put(s.title, escape(title)),
        when_text(meta, put(s.meta, meta)),
        F.lit(s.rule),
        when_text(summary, put(s.summary, escape(summary))),
        lines,
        F.when(F.size(keywords) > 0, put(KEYWORD_BOX, words)).otherwise(""),
        F.lit(s.end),
        put(s.foot, F.concat(when_text(link, put(s.link, escape(link))), F.lit(s.closing.replace("{x}", signature)))),
    )


def html_document(title: Column, body: Column) -> Column:
    return fill(DOCUMENT, title=F.replace(escape(title), F.lit('"'), F.lit("&quot;")), body=body)


# The digest mail, line by line.
MAIL_HEAD = (
    '<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"></head>\n<body style="font-family:-apple-system,sans-serif;padding:20px;background:#f5f5f5;">\n'
    '<div style="max-width:640px;margin:0 auto;background:#fff;border-radius:8px;overflow:hidden;box-shadow:0 1px 3px rgba(0,0,0,0.1);">\n'
    '<div style="background:#1a73e8;padding:20px;color:#fff;">\n  <h1 style="margin:0;font-size:20px;">周报 {week}</h1>\n'
    '  <p style="margin:4px 0 0;font-size:13px;opacity:0.9;">{monday} ~ {sunday}</p>\n</div>\n'
    '<div style="padding:16px 20px;background:#e8f0fe;font-size:13px;color:#555;">\n'
    "  本周共采集 <strong>{articles}</strong> 篇文章，覆盖 <strong>{groups}</strong> 个分类\n</div>\n"
)
MAIL_HEALTH = (
    '<div style="padding:16px 20px;font-size:13px;color:#555;"><h3 style="margin:0 0 8px;font-size:14px;color:#333;">系统健康度</h3>'
    '<p style="margin:0 0 8px;">总请求 <strong>{attempts}</strong>，失败 <strong>{fails}</strong>，失败率 <strong>{rate}</strong></p>{table}</div>'
)
MAIL_SITES = (
    '<table style="width:100%;border-collapse:collapse;font-size:12px;"><tr><th style="text-align:left;padding:4px 8px;">站点</th>'
    '<th style="text-align:right;padding:4px 8px;">尝试</th><th style="text-align:right;padding:4px 8px;">失败</th>'
    '<th style="text-align:right;padding:4px 8px;">失败率</th></tr>{x}</table>'
)
MAIL_SITE = (
    '<tr><td style="padding:4px 8px;border-bottom:1px solid #eee;">{domain}</td><td style="padding:4px 8px;border-bottom:1px solid #eee;text-align:right;">{attempts}</td>'
    '<td style="padding:4px 8px;border-bottom:1px solid #eee;text-align:right;">{fails}</td><td style="padding:4px 8px;border-bottom:1px solid #eee;text-align:right;">{rate}</td></tr>'
)
MAIL_NO_SITES = '<p style="font-size:12px;color:#777;">本周无降级记录</p>'
MAIL_OPEN = '<div style="padding:0 20px 20px;">\n  <table style="width:100%;border-collapse:collapse;">'
MAIL_GROUP = '<tr><td style="padding:12px 0 4px;"><h3 style="margin:0;color:#333;">📋 {name}（{size}篇）</h3></td></tr>'
MAIL_ARTICLE = (
    '<tr style="border-bottom:1px solid #eee;">\n  <td style="padding:10px 8px;vertical-align:top;">\n'
    '    <a href="{url}" style="color:#1a73e8;text-decoration:none;font-weight:500;">{title}</a>\n'
    '    <div style="color:#666;font-size:12px;margin-top:2px;">{source} · {date}</div>\n'
    '    <div style="color:#333;font-size:13px;margin-top:4px;line-height:1.5;">{summary}</div>\n  </td>\n</tr>'
)
MAIL_FOOT = (
    '  </table>\n</div>\n<div style="padding:12px 20px;font-size:11px;color:#999;border-top:1px solid #eee;text-align:center;">\n'
    "  本邮件由系统自动发送\n</div>\n</div>\n</body>\n</html>"
)


def digest_html(digest: DataFrame, weeks: DataFrame, health: DataFrame) -> DataFrame:
    """The mail of every week as ordered fragments (year_week, part, group_no, publish_date, article_id, fragment).

    ``weeks``: year_week, monday, sunday, total_articles, total_categories. Head, health,
    heading, article and foot are rows of their own: written in row order they are the mail,
    and a week of any size never has to fit into one value.
    """
    c = F.col
    none = {"group_no": F.lit(None).cast("int"), "publish_date": F.lit(None).cast("date"), "article_id": F.lit(None).cast("bigint")}
    row = lambda df, part, fragment, **at: df.select(
        "year_week", F.lit(part).alias("part"), *[at.get(k, v).alias(k) for k, v in none.items()], fragment.alias("fragment")
    )
    head = fill(MAIL_HEAD, week=c("year_week"), monday=c("monday"), sunday=c("sunday"), articles=c("total_articles"), groups=c("total_categories"))
    line = lambda s: fill(MAIL_SITE, domain=s["domain"], attempts=s["attempts"], fails=s["fail_count"], rate=percent(s["fail_rate"]))
    table = F.when(F.size("degraded") > 0, fill(MAIL_SITES, x=mapped(c("degraded"), line))).otherwise(MAIL_NO_SITES)
    block = fill(MAIL_HEALTH, attempts=c("total_attempts"), fails=c("total_fails"), rate=percent(c("fail_rate")), table=table)
    groups = digest.select("year_week", "group_no", "group_name", "group_size").distinct()
    article = fill(MAIL_ARTICLE, url=c("original_link"), title=c("title"), source=F.coalesce("source_unit", F.lit("")), date=c("publish_date"), summary=F.coalesce("summary", F.lit("")))
    return (
        row(weeks, 0, head)
        .unionByName(row(health.join(weeks.select("year_week"), "year_week", "left_semi"), 1, block))
        .unionByName(row(weeks, 2, F.lit(MAIL_OPEN)))
        .unionByName(row(groups, 3, fill(MAIL_GROUP, name=c("group_name"), size=c("group_size")), group_no=c("group_no")))
        .unionByName(row(digest, 3, article, group_no=c("group_no"), publish_date=c("publish_date"), article_id=c("article_id")))
        .unionByName(row(weeks, 4, F.lit(MAIL_FOOT)))
    )


def mail_order(fragments: DataFrame) -> DataFrame:
    """Rows in mail order; a heading (no date) goes before its articles."""
    return fragments.orderBy("year_week", "part", F.asc_nulls_first("group_no"), F.desc_nulls_first("publish_date"), F.asc_nulls_first("article_id"))


def digest_cards(digest: DataFrame, weeks: DataFrame, health: DataFrame) -> DataFrame:
    """One chat card per week as JSON: ten articles per group, twenty elements, then a pointer to the mail.

    Articles are cut to ten per group and groups to the ten that can show before anything
    is gathered, so a card's parts are few whatever the week holds.
    """
    c = F.col
    rank = F.row_number().over(Window.partitionBy("year_week", "group_no").orderBy(F.desc("publish_date"), "article_id"))
    shown = digest.filter(c("group_no") <= MAX_ELEMENTS // 2).withColumn("no", rank).filter(c("no") <= SUMMARY_TOP)
    line = fill("[{title}]({url}) · {date}\n> {summary}", title=c("title"), url=c("original_link"), date=c("publish_date"), summary=F.coalesce("summary", F.lit("")))
    groups = shown.groupBy("year_week", "group_no", "group_name", "group_size").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("t")))).alias("lines"))
    content = F.concat(fill("**📋 {name}（{size}篇）**\n", name=c("group_name"), size=c("group_size")), mapped(c("lines"), lambda x: x["t"], "\n"))
    listed = groups.groupBy("year_week").agg(F.array_sort(F.collect_list(F.struct("group_no", content.alias("t")))).alias("groups"))
    note = lambda text: F.struct(F.lit("markdown").alias("tag"), text.alias("content"))
    bar = F.struct(F.lit("hr").alias("tag"), F.lit(None).cast("string").alias("content"))
    site = lambda s: fill("- {domain}：{fails}/{attempts}（{rate}）", domain=s["domain"], fails=s["fail_count"], attempts=s["attempts"], rate=percent(s["fail_rate"]))
    state = F.array_join(
        F.concat(
            F.array(fill("系统健康度：总请求 **{a}**，失败 **{f}**，失败率 **{r}**", a=c("total_attempts"), f=c("total_fails"), r=percent(c("fail_rate")))),
            F.transform(F.coalesce("degraded", F.array().cast(health.schema["degraded"].dataType)), site),
        ),
        "\n",
    )
    joined = weeks.join(listed, "year_week").join(health, "year_week", "left")
    intro = fill("本周共采集 **{a}** 篇文章，覆盖 **{g}** 个分类", a=c("total_articles"), g=c("total_categories"))
    elements = F.concat(
        F.array(note(intro), bar),
        F.flatten(F.transform("groups", lambda g: F.array(note(g["t"]), bar))),
        F.when(c("total_attempts").isNotNull(), F.array(bar, note(state))).otherwise(F.array().cast("array<struct<tag:string,content:string>>")),
    )
    full = 2 + 2 * c("total_categories") + F.when(c("total_attempts").isNotNull(), 2).otherwise(0)
    more = note(fill("… 共 {a} 篇，完整内容请查看邮件", a=c("total_articles")))
    kept = F.when(full > MAX_ELEMENTS, F.concat(F.slice(elements, 1, MAX_ELEMENTS), F.array(more))).otherwise(elements)
    header = F.struct(F.struct(F.lit("plain_text").alias("tag"), fill("周报 {w}（{m} ~ {s}）", w=c("year_week"), m=c("monday"), s=c("sunday")).alias("content")).alias("title"))
    card = F.to_json(F.struct(F.lit("interactive").alias("msg_type"), F.struct(header.alias("header"), kept.alias("elements")).alias("card")))
    return joined.select("year_week", F.size(kept).alias("elements"), card.alias("card"))


# Which channel takes which form; a channel without one sends nothing.
CHANNELS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {"email": digest_html, "webhook": digest_cards}


def for_channels(configs: Sequence[dict], digest: DataFrame, weeks: DataFrame, health: DataFrame) -> DataFrame:
    """What each enabled channel is to be sent, in its own form: (config_id, channel, year_week, pieces, text).

    A form is made once and handed to every configuration that asks for it. Mail is text
    in pieces (one row per fragment), a card is one row that counts its elements.
    """
    live = [c for c in configs if c["enabled"] and c["channel"] in CHANNELS]
    sent = None
    for channel in dict.fromkeys(c["channel"] for c in live):
        made = CHANNELS[channel](digest, weeks, health)
        text, pieces = ("card", F.col("elements").cast("bigint")) if channel == "webhook" else ("fragment", F.lit(1).cast("bigint"))
        to = F.array(*[F.lit(c["config_id"]).cast("bigint") for c in live if c["channel"] == channel])
        rows = made.select(F.explode(to).alias("config_id"), F.lit(channel).alias("channel"), "year_week", pieces.alias("pieces"), F.col(text).alias("text"))
        sent = rows if sent is None else sent.unionByName(rows)
    return sent


def export_rows(wanted: DataFrame, titled: DataFrame) -> DataFrame:
    """Export context of ``wanted(pos, article_id)``: title, meta line, summary, lists as text, body paragraphs."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    meta = F.array_join(
        F.filter(
            F.array(
                F.when(F.col("publish_date").isNotNull(), F.concat(F.lit("发布日期："), F.col("publish_date").cast("string"))),
                F.when(filled(F.col("source_unit")), F.concat(F.lit("来源："), "source_unit")),
            ),
            lambda m: m.isNotNull(),
        ),
        " | ",
    )
    return wanted.join(titled, "article_id").select(
        "pos",
        "article_id",
        F.when(filled(F.col("title")), F.col("title")).otherwise("无标题").alias("title"),
        meta.alias("meta"),
        "summary",
        F.array_join("keywords", "、").alias("keywords"),
        mapped(F.col("categories"), lambda x: x["label"], "、").alias("categories"),
        paragraphs(F.col("raw_content")).alias("body_paragraphs"),
    )
