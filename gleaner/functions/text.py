"""Text columns: cleaning, tokens, hashes, page and article verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.stage import bind, once

# Titles that end in one of these belong to static pages.
STATIC_TITLES = (
    "学校沿革", "历史沿革", "沿革", "学校简介", "学校概况", "关于我们", "简介",
    "机构设置", "部门设置", "组织架构", "内设机构", "机构职能",
    "领导介绍", "领导班子", "现任领导", "历任领导", "领导信箱",
    "校园风光", "校园地图", "校园导览", "校区介绍",
    "招生就业", "招生信息", "招生简章", "本科招生", "研究生招生",
    "师资队伍", "师资力量", "名师风采", "教师风采", "杰出人才",
    "学科建设", "专业设置", "重点学科", "学科简介",
    "校史", "校训", "校歌", "校徽", "校庆",
    "联系我们", "联系方式", "交通指南", "来校路线",
    "信息公开指南", "信息公开目录",
    "规章制度", "政策法规",
    "校友会", "校友总会", "教育基金会",
    "图书馆", "档案馆", "网络中心",
    "校园文化", "学生工作", "学生社团",
    "合作交流", "国际交流", "国际合作",
    "党建工作", "思政工作", "纪检监察",
    "安全保卫", "后勤服务", "物业服务",
    "本科教育", "本科专业", "研究生教育", "终身教育", "招生教育",
    "继续教育", "优质课程", "特色项目", "实践教学", "教学成果",
    "教学名师", "奖助体系", "国际化培养", "学位教育",
    "学术学位", "专业学位", "学术期刊", "技术转移", "论文著作",
    "获奖成果", "企业合作", "地方合作", "科研机构",
    "科研项目", "重大项目", "学术交流", "清华论坛", "媒体关注",
)
# Text that betrays a cut-off body.
TRUNCATION_MARKERS = (
    "阅读全文", "点击查看详情", "登录后查看", "请登录后查看",
    "展开全文", "查看更多", "查看全部", "立即登录",
    "注册后查看", "下载APP查看", "查看全文",
)
# Vendor and generic signs of a block page.
CLOUDFLARE = ("checking your browser", "cf-ray", "__cf_bm", "cf-browser-verification", "cloudflare", "please wait", "ddos protection")
DATADOME = ("datadome", "dd.interstitial")
CAPTCHA = ("captcha", "recaptcha", "g-recaptcha", "hcaptcha", "turnstile", "i'm not a robot", "verify you are human")
GENERIC_BLOCK = (
    r"access\s*denied", r"forbidden", r"blocked", r"too\s*many\s*requests",
    r"your\s*ip\s*has\s*been\s*blocked", r"unusual\s*traffic", r"automated\s*requests",
)
MIN_REAL_PAGE = 800
# Photo credit, source and editor lines.
CREDIT_LINE = (
    r"(?m)^(?:(?:新华社|中新社|人民日报|央视|光明日报|经济日报)?(?:记者\s*)?[^\n]{1,6}\s*(?:摄|摄影|拍摄|供图|图|照片)"
    r"|图[/／][^\n]{1,10}|摄影[：:][^\n]{1,10}|(?:图片|影像)[：:][^\n]{1,10}|编辑[：:][^\n]{1,10}|来源[：:][^\n]{1,20})\s*$"
)
# Stop words per language, for the language gate.
STOP_WORDS = {
    "en": ("the", "and", "of", "is", "that", "with"),
    "fr": ("le", "les", "des", "une", "est", "dans"),
    "de": ("der", "die", "und", "ist", "ein", "nicht"),
    "es": ("el", "los", "una", "que", "para", "no"),
}


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_noise(text: Column) -> Column:
    """Drop emphasis marks and credit lines, squeeze blank lines, trim."""
    plain = F.regexp_replace(text, r"(?s)\*{1,2}(.+?)\*{1,2}", "$1")
    return strip(F.regexp_replace(F.regexp_replace(plain, CREDIT_LINE, ""), r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    blocks = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n\n+")
    return F.filter(F.transform(blocks, strip), lambda b: b != "")


def tokens(text: Column) -> Column:
    """Latin runs in lower case; CJK runs of two or more whole."""
    runs = F.regexp_extract_all(text, F.lit("[a-zA-Z]+|[一-龥]+"), F.lit(0))
    kept = F.filter(runs, lambda w: w.rlike("^[a-zA-Z]") | (F.length(w) >= 2))
    return F.transform(kept, lambda w: F.lower(w))


def fingerprint(title: Column, body: Column) -> Column:
    """Of the whole title and text, each stripped; a null counts as empty."""
    return F.md5(F.concat(strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit("")))))


def simhash64(text: Column) -> Column:
    """Signed 64-bit SimHash over token occurrences; NULL when there is no token.

    Bits are counted in eight longs of eight 8-bit lanes, 127 tokens at a time (no lane,
    not even the one with the sign bit, can overflow then), and the slices' counts are
    added up. A token costs eight additions and everything stays inside the row: no
    explode, no shuffle.
    """
    long = lambda n: F.lit(n).cast("bigint")
    ones, full = long(0x0101010101010101), 127
    shift = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z]+|[一-龥]{2,}"), F.lit(0))
    to_long = lambda w: F.conv(F.substring(F.md5(w), 17, 16), 16, -10).cast("bigint")

    def lanes(part: Column) -> Column:
        """64 counts of one slice; entry 8k + j counts bit 8j + k."""
        packed = F.aggregate(part, F.array_repeat(long(0), 8), lambda acc, x: F.transform(acc, lambda c, k: c + shift(x, k).bitwiseAND(ones)))
        places = F.array(*[F.lit(8 * j) for j in range(8)])
        return F.flatten(F.transform(packed, lambda c: F.transform(places, lambda p: shift(c, p).bitwiseAND(long(0xFF)))))

    def signed(h: Column) -> Column:
        n = F.size(h)
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / full).cast("int")), lambda i: F.slice(h, i * full + 1, F.lit(full)))
        counts = F.aggregate(parts, F.array_repeat(long(0), 64), lambda a, p: F.zip_with(a, lanes(p), lambda x, y: x + y))
        bit = lambda c, i: F.when(c * 2 > n, F.call_function("shiftleft", long(1), F.pmod(i, F.lit(8)) * 8 + F.floor(i / 8).cast("int"))).otherwise(long(0))
        return F.aggregate(F.transform(counts, bit), long(0), lambda a, b: a.bitwiseOR(b))

    return bind(F.transform(words, to_long), lambda h: F.when(F.size(h) > 0, signed(h)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def completeness(body: Column, title: Column) -> Column:
    """'ok', or the first reason why the body looks incomplete."""
    lines = F.size(F.filter(F.split(body, "\n"), lambda s: s.rlike(r"\S")))
    marker = F.get(F.filter(F.array(*[F.lit(m) for m in TRUNCATION_MARKERS]), lambda m: body.contains(m)), F.lit(0))
    starts = F.sequence(F.lit(1), F.length(title) - 1, F.lit(2))
    echoed = body.contains(title) | F.exists(starts, lambda i: body.contains(F.substring(title, i, F.lit(2))))
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "empty_content")
        .when(lines < 2, F.concat(F.lit("too_few_paragraphs("), lines, F.lit(")")))
        .when(marker.isNotNull(), F.concat(F.lit("truncation_marker("), marker, F.lit(")")))
        .when(body.rlike(r"\n{5,}"), "excessive_newlines")
        .when((F.length(title) >= 4) & ~echoed, "title_not_in_body")
        .otherwise("ok")
    )


def draft_valid(title: Column, body: Column) -> Column:
    return F.coalesce(title.rlike(r"\S") & (F.length(strip(body)) >= 200), F.lit(False))


def quality_score(body: Column, published: Column) -> Column:
    """0 is fine; -2 or less is not an article."""
    n = F.length(F.coalesce(body, F.lit("")))
    return F.when(n < 300, -2).when(n < 500, -1).otherwise(0) + F.when(published.isNull(), -1).otherwise(0)


def language(text: Column) -> Column:
    """Main language of a text: script first, then stop-word hits; NULL when nothing speaks for any."""
    count = lambda s, p: F.regexp_count(s, F.lit(p))
    hits = lambda s: [F.struct(count(s, rf"(?i)\b(?:{'|'.join(w)})\b").alias("n"), F.lit(c).alias("lang")) for c, w in STOP_WORDS.items()]

    def decide(s: Column) -> Column:
        best = F.array_max(F.array(*hits(s)))
        cjk = count(s, "[一-龥]")
        return F.when(cjk * 5 > F.length(s), "zh").when(best["n"] > 0, best["lang"])

    return bind(text, decide)


def language_gate(df: DataFrame, text: str, expected) -> DataFrame:
    """Rows in an expected language or in none that can be told; adds ``found``."""
    told = once(df, "found", language(F.col(text)))
    return told.filter(F.col("found").isNull() | F.col("found").isin(*expected))


def static_title(title: Column) -> Column:
    return title.rlike("(?:" + "|".join(STATIC_TITLES) + r")\z")


def block_verdict(html: Column, status: Column, headers: Column) -> Column:
    """struct(blocked, block_type, confidence): vendor marks, then status, then content."""
    n = F.length(html)

    def decide(text: Column) -> Column:
        marks = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
        generic = sum((text.rlike(p).cast("int") for p in GENERIC_BLOCK), F.lit(0))
        cf_header = F.exists(F.map_keys(headers), lambda k: F.lower(k) == "cf-ray")
        say = lambda kind, c: F.struct(F.lit(True).alias("blocked"), F.lit(kind).alias("block_type"), F.lit(c).alias("confidence"))
        clear = F.struct(F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("block_type"), F.lit(0.0).alias("confidence"))
        return (
            F.when(F.coalesce(html, F.lit("")) == "", clear)
            .when((marks(CLOUDFLARE) >= 2) | F.coalesce(cf_header, F.lit(False)) | text.contains("__cf_bm"), say("cloudflare", 0.9))
            .when(marks(DATADOME) >= 1, say("cloudflare", 0.85))
            .when(marks(CAPTCHA) >= 2, say("captcha", 0.85))
            .when(status == 429, say("ratelimit", 0.9))
            .when(status.isin(403, 503) & (n < MIN_REAL_PAGE * 2), say("generic", 0.7))
            .when((generic >= 2) & (n < MIN_REAL_PAGE * 3), say("generic", 0.6))
            .when(n < MIN_REAL_PAGE, say("generic", 0.5))
            .otherwise(clear)
        )

    return bind(F.lower(html), decide)


def body_text_length(html: Column) -> Column:
    """Length of the body's text, each piece trimmed, without scripts, styles and comments."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1)
    bare = F.regexp_replace(body, r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->", "")
    pieces = F.transform(F.split(bare, "<[^>]*>"), strip)
    return F.length(unescape(F.array_join(pieces, "")))


def unescape(text: Column) -> Column:
    """The character references web pages mostly use, with or without their semicolon."""
    for pattern, char in (("&nbsp;?", " "), ("&quot;?", '"'), ("&#39;?", "'"), ("&lt;?", "<"), ("&gt;?", ">"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        text = F.regexp_replace(text, pattern, char)
    return text


def static_page_ok(html: Column, status: Column, min_length: int = 500, min_tags: int = 10) -> Column:
    """Usable without running scripts: status, length, tags, and enough text of its own."""
    n = F.length(html)
    occurrences = lambda s: (n - F.length(F.replace(html, F.lit(s), F.lit("")))) / len(s)
    tags = occurrences("<") + occurrences("</")
    enough = bind(body_text_length(html), lambda m: ~((m / F.greatest(n, F.lit(1)) < 0.1) & (m < 500)))
    return (status == 200) & (n >= min_length) & (tags >= min_tags) & enough


def salvage_json(text: Column) -> Column:
    """The text as JSON, else its outermost {...} span, else NULL."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
