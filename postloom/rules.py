"""Parameters of a tally: topics, their aliases, and the rule that says which posts count."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


#: How reasons may call a topic, by the first part of its id.
PREFIXES = {
    "theme1": ["主题1", "主题一"],
    "theme2": ["主题2", "主题二"],
    "theme3": ["主题3", "主题三"],
    "theme4": ["主题4", "主题四"],
    "qa": ["特别环节", "Q&A", "qa", "问答"],
}


@dataclass(frozen=True)
class Topic:
    id: str
    name: str
    short_name: str
    allow_multiple_per_author: bool = False
    description: str = ""
    end_time: str | None = None

    def prefixes(self) -> list[str]:
        """How a reason may already begin with the topic."""
        kind = self.id.split("_")[0] if "_" in self.id else self.id
        return [self.name, self.short_name, *PREFIXES.get(kind, [])]


#: The topics of the default thread, in order, with what they ask for and when they end.
TOPICS = (
    Topic("theme1_travel", "主题1：旅行", "旅行", description="人物、地点、事件形式的暑假马车旅行安价。", end_time="2026-05-04 23:00"),
    Topic("theme2_training", "主题2：女仆修行 livehouse / 修行之道", "修行之道", description="老师、主要属性培养、事件形式的女仆培训安价。", end_time="2026-05-04 23:00"),
    Topic("theme2_guest", "主题2：女仆修行 livehouse / 难缠之客", "难缠之客", description="客人、事件形式的委托或招待测试安价。", end_time="2026-05-04 23:00"),
    Topic("theme3_engagement", "主题3：订婚大作战", "订婚", description="人物、地点、事件形式的促成贴贴安价。", end_time="2026-05-04 23:00"),
    Topic("theme4_carriage_name", "主题4：马车的名字", "马车名字", description="安价名字形式的马车命名。", end_time="2026-05-04 23:00"),
    Topic("qa", "特别环节：诡秘小祥一周年 Q&A", "Q&A", allow_multiple_per_author=True, description="向神奇小猪提问；同一作者可提交多个问题。"),
)
#: Other names of the topics.
ALIASES = {
    "主题1": "theme1_travel",
    "主题一": "theme1_travel",
    "theme1": "theme1_travel",
    "travel": "theme1_travel",
    "旅行": "theme1_travel",
    "旅游": "theme1_travel",
    "主题2": "theme2_training",
    "主题二": "theme2_training",
    "theme2": "theme2_training",
    "女仆修行": "theme2_training",
    "修行之道": "theme2_training",
    "training": "theme2_training",
    "难缠之客": "theme2_guest",
    "难缠的客人": "theme2_guest",
    "难缠顾客": "theme2_guest",
    "不速之客": "theme2_guest",
    "guest": "theme2_guest",
    "客人": "theme2_guest",
    "主题3": "theme3_engagement",
    "主题三": "theme3_engagement",
    "theme3": "theme3_engagement",
    "订婚": "theme3_engagement",
    "订婚大作战": "theme3_engagement",
    "engagement": "theme3_engagement",
    "主题4": "theme4_carriage_name",
    "主题四": "theme4_carriage_name",
    "theme4": "theme4_carriage_name",
    "马车名字": "theme4_carriage_name",
    "马车名称": "theme4_carriage_name",
    "马车的名字": "theme4_carriage_name",
    "carriage_name": "theme4_carriage_name",
    "特别环节": "qa",
    "q&a": "qa",
    "qa": "qa",
    "问答": "qa",
}


@dataclass(frozen=True)
class Rule:
    """Posts after start_lou, up to end_lou and end_time, not by ignored authors, not on ignored floors, with the keyword."""

    start_lou: int
    end_lou: int | None = None
    end_time: str | None = None
    ignore_author_user: tuple[int, ...] = ()
    not_anjia_lou_list: tuple[int, ...] = ()
    keyword: str | None = None
    topics: tuple[Topic, ...] = field(default=TOPICS)
    #: What a model is told about single floors, and how much of a post it is shown (0: all).
    floor_notes: tuple[tuple[int, str], ...] = ()
    post_char_limit: int = 7000

    def overridden(self, **given) -> Rule:
        """Given values replace the rule's; lists of ids are united with it."""
        lists = {k: tuple(dict.fromkeys([*getattr(self, k), *given.pop(k)])) for k in ("ignore_author_user", "not_anjia_lou_list") if given.get(k) is not None}
        return replace(self, **{k: v for k, v in given.items() if v is not None}, **lists)

    def with_default_topics(self) -> Rule:
        """Default topics that the rule does not name are added after its own."""
        known = {t.id for t in self.topics}
        return replace(self, topics=(*self.topics, *(t for t in TOPICS if t.id not in known)))
