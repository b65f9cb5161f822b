"""Rule tables that expand queries and boost candidates, and their compilation to columns.

A rule is data. What names a site, its people or its units comes from a SiteProfile, so the tables hold vocabulary only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.columns import contains_all, contains_any, strip, text
from textloom.functions.dates import cutoff, date_boost, extract_dates
from textloom.functions.text import haystack

COURSE_TITLE = r"《([^》]{2,40})》"


@dataclass(frozen=True)
class SiteProfile:
    """What a deployment calls itself. All strings are matched as written; English ones are given in lower case."""

    site_url: str = "https://www.example.edu/"
    site_host: str = "www.example.edu"
    admission_url: str = "https://school.example.edu/2825/list.htm"
    university: str = "示例大学"
    university_en: str = "example university"
    school: str = "信息学院"
    school_full: str = "信息科学与技术学院"
    school_en: str = "school of information science and technology"
    about_titles: tuple[str, ...] = ("学院介绍", "About")
    about_text: str = "about the school"
    english_path: str = "/school_en"
    street: tuple[str, ...] = ("示例路", "example road")
    founding_dean: tuple[str, ...] = ("创始人", "founding dean")
    dean: str = "现任院长"
    dean_centre: str = "视觉与数据智能中心 VDI"
    centres: tuple[tuple[str, str], ...] = (("后摩尔器件与集成系统中心", "pmicc"), ("智慧电气科学中心", "cipes"))
    centre_topics: tuple[str, ...] = ("新型器件 电路 系统", "智能电网 电动车 物联网 大数据 人工智能")
    centre_terms: tuple[str, ...] = ("研究中心", "联合实验室", "省部级研究中心", "vdi", "pmicc", "cipes", "star", "smirc", "ssc")
    dean_terms: tuple[str, ...] = ("视觉与数据智能", "dean", "vdi")
    robotics_people: str = ""
    admission_paths: tuple[str, ...] = ("/2825/", "/2826/", "/2827/", "c2826", "c2863", "c7340")
    admission_list: str = "2825/list.htm"
    stopwords: tuple[str, ...] = ("示例大学",)


# What makes a question one about time, the founding dean, an exact address.
TIME = ["最新", "最近", "当前", "截止", "截至", "本学期", "现在", "发布", "2026", "2025"]
FOUNDING = ["创始院长", "创院院长", "首任院长", "第一任院长"]
WEBSITE = ["官方网址", "官方网站", "官网", "网址", "网站"]
EXACT_URL = ["官方网址", "官方网站", "网址是什么", "官网是什么"]
EXACT_URL_BOTH, EXACT_URL_NOT = ["官网", "什么"], ["讲座", "新闻", "招生信息", "发布"]


def is_time_query(q: Column) -> Column:
    return contains_any(q, TIME)


def is_founding_query(q: Column) -> Column:
    return contains_any(q, FOUNDING)


def is_website_query(q: Column) -> Column:
    return contains_any(q, WEBSITE)


def is_exact_url_query(q: Column) -> Column:
    return contains_any(q, EXACT_URL) | (contains_all(q, EXACT_URL_BOTH) & ~contains_any(q, EXACT_URL_NOT))


def course_titles(q: Column) -> Column:
    """The titles between double angle brackets of a question, stripped."""
    return F.filter(F.transform(F.regexp_extract_all(q, F.lit(COURSE_TITLE), F.lit(1)), strip), lambda t: t != "")


@dataclass(frozen=True)
class Trigger:
    """A condition on a question: one of any, all of all, none of none, and a named predicate."""

    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    predicate: str = ""

    def holds(self, q: Column) -> Column:
        out = F.lit(True)
        if self.any:
            out = out & contains_any(q, list(self.any))
        if self.all:
            out = out & contains_all(q, list(self.all))
        if self.none:
            out = out & ~contains_any(q, list(self.none))
        if self.predicate:
            known = {"time": is_time_query, "founding": is_founding_query, "exact_url": is_exact_url_query}
            out = out & (F.size(course_titles(q)) > 0 if self.predicate == "course" else known[self.predicate](q))
        return out


@dataclass(frozen=True)
class Expansion:
    """What a question gets added if one of the triggers holds."""

    triggers: tuple[Trigger, ...]
    added: str


@dataclass(frozen=True)
class Boost:
    """A score for candidates of questions where the trigger holds. The steps of a rule are tried in order; the first that
    holds counts. A step is (condition, delta); a condition maps field names to terms, one of which the field must hold.
    Fields: hay and url (lower case), title (as written), title_low, title_is (equality), both (all in hay)."""

    trigger: Trigger
    steps: tuple[tuple[tuple[tuple[str, tuple[str, ...]], ...], float], ...]


def expansions(site: SiteProfile) -> list[Expansion]:
    """The expansions, in order."""
    t = Trigger
    centre_text = " ".join(f"{name} {short.upper()} {topic}" for (name, short), topic in zip(site.centres, site.centre_topics, strict=True))
    return [
        Expansion((t(any=("本科", "学分", "培养方案", "毕业", "专业")),), "本科生培养 培养方案 2025级 2024级 总学分要求 计算机科学与技术 电子信息工程 CS EE Degree Programs"),
        Expansion((t(any=("成立",)),), f"学院介绍 成立于2013年 {site.school_full} {site.school_en}"),
        Expansion((t(any=("研究生", "硕士", "博士", "招生", "调剂", "报考", "申请", "考核")),), "研究生招生 通知公告 报考指南 招生Q&A 培养方案 硕士研究生招生 博士研究生招生 2825 2826 2827"),
        Expansion((t(all=("研究生招生",), any=("网站", "网址", "发布")),), f"{site.admission_url} {site.admission_list} 研究生招生 通知公告"),
        Expansion((t(predicate="exact_url"),), f"{site.site_url} {site.site_host} {site.university_en} official website 官方网站 官网"),
        Expansion((t(any=("课程", "任课", "课程代码", "开设", "本学期")), t(predicate="course")), "课程表 本硕博课程体系 本科生教学教务 研究生教学教务 course schedule 任课老师 课程代码"),
        Expansion((t(any=("老师", "导师", "邮箱", "主页", "研究方向", "教授")),), "师资队伍 常任教授 教师主页 个人主页 邮箱 研究方向 招生入口 中文信息 英文信息"),
        Expansion((t(predicate="founding"),), f"创始院长 创院院长 首任院长 {' '.join(site.founding_dean)} 学院介绍 {site.school_full}"),
        Expansion((t(any=("院长",), none=tuple(FOUNDING)),), f"院长 {site.dean} Dean Executive Dean {site.dean_centre} 师资队伍 学院介绍"),
        Expansion((t(any=("研究中心", "实验室", "中心")),), "研究中心 联合实验室 省部级研究中心 常任教授 " + " ".join(x.upper() for x in site.centre_terms if x.isascii())),
        Expansion((t(all=tuple(name for name, _ in site.centres)),), centre_text),
        Expansion((t(any=("讲座",)),), "学术讲座 讲座通知 学术活动 seminar lecture event"),
        Expansion((t(any=("地址", "校区", "官网", "网址", "网站", "英文名称", "英文名")),), f"Address {' '.join(site.street)} {site.school_en} {site.university_en}"),
        Expansion((t(all=(site.school,), any=("英文名称", "英文名")),), f"{site.english_path.strip('/')} {site.school_en} {site.about_titles[-1]} Vision and Mission"),
        Expansion((t(any=("机器人", "自动化")),), f"自动化与机器人中心 STAR {site.robotics_people}".strip()),
        Expansion((t(predicate="time"),), "发布时间 发布者 通知公告 新闻 学术讲座 学术活动 2026 2025 list list1"),
    ]


def boosts(site: SiteProfile) -> list[Boost]:
    """The boosts."""
    t = Trigger
    hay = lambda *terms: (("hay", terms),)
    (first, first_short), (second, second_short) = site.centres
    dean = t(any=("院长",), none=tuple(FOUNDING))
    english = t(any=("英文名称", "英文名"))
    school_english = t(any=("英文名称", "英文名"), all=(site.school,))
    return [
        Boost(t(any=("招生", "调剂", "报考", "博士", "硕士")), (((("url", site.admission_paths),), 0.035), ((("title", ("招生",)),), 0.035))),
        Boost(t(any=("招生", "调剂", "报考", "博士", "硕士"), all=("研究生招生",)), (((("url", (site.admission_list,)),), 0.12),)),
        Boost(t(any=("课程", "任课", "课程代码", "开设", "学分", "培养方案", "毕业")), ((hay("课程表", "培养方案", "degree", "schedule", "course", "总学分要求"), 0.04),)),
        Boost(t(all=("成立", site.school)), (((("title_is", site.about_titles),), 0.16), (hay("创始院长", "成立于2013年", site.about_text), 0.16))),
        Boost(t(any=("老师", "导师", "邮箱", "研究方向", "主页", "教授")), ((hay("师资", "常任教授", "中文信息", "英文信息", "faculty", "e-mail", "邮箱", "research area"), 0.04),)),
        Boost(t(any=("研究中心", "实验室", "中心")), ((hay(*site.centre_terms), 0.035),)),
        Boost(t(all=(first, second)), (((("both", (first, second)),), 0.12), (hay(first, first_short), 0.08), (hay(second, second_short), 0.08))),
        Boost(t(any=("讲座",)), ((hay("学术讲座", "讲座通知", "学术活动", "seminar", "lecture"), 0.12),)),
        Boost(t(predicate="founding"), ((hay(*site.founding_dean), 0.38),)),
        Boost(t(predicate="founding"), ((hay("创始院长", "创院院长"), 0.16), ((("title_is", site.about_titles[:1]),), 0.16))),
        Boost(t(predicate="founding"), ((hay(site.dean), -0.16),)),
        Boost(dean, ((hay(site.dean), 0.28),)),
        Boost(dean, ((hay(*site.dean_terms), 0.09),)),
        Boost(dean, (((("title_is", (*site.about_titles[:1], "院务委员会", "院长寄语", "师资队伍")),), 0.08),)),
        Boost(t(any=("地址", "校区")), ((hay(*site.street, "address"), 0.06),)),
        Boost(t(predicate="exact_url"), ((hay(site.site_url), 0.22), (hay(site.site_host), 0.08))),
        Boost(t(predicate="exact_url"), ((hay("sseinfo.com", "yz.chsi", "bilibili"), -0.06),)),
        Boost(english, ((hay(site.school_en, site.university_en), 0.06),)),
        Boost(school_english, (((("title_low", (site.school_en,)),), 0.13),)),
        Boost(school_english, (((("url", (site.english_path,)),), 0.08),)),
        Boost(english, (((("title_low", ("symposium",)),), -0.04),)),
    ]


#: The score of candidates that hold a course title of the question.
COURSE_BOOST = 0.08


@dataclass
class RuleSet:
    """Compiles the tables of a site."""

    site: SiteProfile = field(default_factory=SiteProfile)

    def vocabulary(self) -> list[str]:
        """The CJK words that the tables know, for a segmenter."""
        triggers = [t for r in expansions(self.site) for t in r.triggers] + [b.trigger for b in boosts(self.site)]
        found = {w for r in expansions(self.site) for w in r.added.split()} | {w for t in triggers for w in (*t.any, *t.all, *t.none)}
        found |= {term for b in boosts(self.site) for condition, _ in b.steps for _, terms in condition for term in terms}
        return sorted(w for w in found if re.fullmatch("[一-鿿]{2,}", w))

    def expansion_list(self, q: Column) -> Column:
        """The texts that a question gets added, in order; course titles come last."""
        parts = []
        for rule in expansions(self.site):
            holds = F.lit(False)
            for trigger in rule.triggers:
                holds = holds | trigger.holds(q)
            parts.append(F.when(holds, F.array(F.lit(rule.added))).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts, course_titles(q))

    def variants(self, q: Column) -> Column:
        """Array of (text, weight): the question; with expansions also with all of them, and with each of the first four."""
        found = self.expansion_list(q)
        pair = lambda x, w: F.struct(x.alias("text"), F.lit(w).alias("weight"))
        more = F.concat(
            F.array(pair(F.concat_ws(" ", q, F.array_join(found, " ")), 0.9)),
            F.transform(F.slice(found, 1, 4), lambda e: pair(F.concat_ws(" ", q, e), 0.65)),
        )
        return F.when(F.size(found) > 0, F.concat(F.array(pair(q, 1.0)), more)).otherwise(F.array(pair(q, 1.0)))

    def route_boost(self, q: Column, title: Column, url: Column, body: Column) -> Column:
        """The boost of a candidate for a question."""
        title = text(title)
        hay, low_url = haystack(title, url, body), F.lower(text(url))
        fields = {"hay": hay, "url": low_url, "title": title, "title_low": F.lower(title)}
        total = F.lit(0.0)
        for rule in boosts(self.site):
            value = None
            for condition, delta in rule.steps:
                holds = F.lit(True)
                for name, terms in condition:
                    holds = holds & (title.isin(list(terms)) if name == "title_is" else contains_all(hay, list(terms)) if name == "both" else contains_any(fields[name], list(terms)))
                value = (F if value is None else value).when(holds, delta)
            total = total + F.when(rule.trigger.holds(q), value.otherwise(0.0)).otherwise(0.0)
        course = F.exists(course_titles(q), lambda c: hay.contains(F.lower(c)))
        dated = F.when(is_time_query(q), date_boost(extract_dates(hay), cutoff(q))).otherwise(0.0)
        return total + F.when(course, COURSE_BOOST).otherwise(0.0) + dated
