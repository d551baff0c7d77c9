"""The rule set: keyword lists, aliases, contact patterns, thresholds and weights, with a YAML loader."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# Fixed values of the default rule set.
MEDICAL = ("医保", "医保卡", "统筹", "报销", "门诊统筹", "住院报销", "特药", "双通道", "收药", "高价收药", "药品回收", "保取", "保提")
ILLEGAL = ("套现", "取现", "提现", "回收", "高价回收", "收药", "高价收药", "药品回收", "帮办", "代办", "秒到账", "现金结算")
CONTACT = ("电话", "手机", "微信", "vx", "VX", "qq", "QQ", "联系")
NOISE = ("租房", "出租", "招租", "出售", "售房", "房屋", "公寓", "写字楼", "招聘", "招工", "求职", "兼职", "家政", "搬家", "开锁", "疏通", "维修", "收车", "二手车")
#: Noise words beside the configured ones: when boxes are judged, and when a reading is.
NOISE_OF_BOXES = ("刻章", "办证", "贷款", "发票")
NOISE_OF_READINGS = ("刻章", "办证", "贷款", "发票", "搬家", "租房", "招聘")
MEDICAL_ALIASES = {"医保卡": ("医保咔", "医保长")}
ILLEGAL_ALIASES = {"提现": ("提镜", "提现秒到"), "收药": ("收藥",)}
#: Java patterns; the flags make classes and case as wide as Unicode.
PHONE = r"(?U)(?<!\d)(1[3-9][0-9\-\s]{9,15})(?!\d)"
WECHAT = r"(?iU)(?:微信|vx|V[Xx]|wechat)[:：\s]*([a-zA-Z][-_a-zA-Z0-9]{5,19})"
QQ = r"(?iU)(?:qq|QQ)[:：\s]*([1-9][0-9]{4,11})"
SCORES = {
    "medical_base": 12, "medical_per_hit": 6, "medical_cap": 35, "illegal_base": 15, "illegal_per_hit": 8, "illegal_cap": 40, "phone": 24,
    "wechat": 18, "qq": 16, "medical_with_contact": 20, "medical_illegal_combo": 12, "illegal_multi_bonus": 10,
}


@dataclass(frozen=True)
class RuleSet:
    medical_keywords: tuple[str, ...] = MEDICAL
    illegal_keywords: tuple[str, ...] = ILLEGAL
    contact_keywords: tuple[str, ...] = CONTACT
    noise_keywords: tuple[str, ...] = NOISE
    medical_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(MEDICAL_ALIASES))
    illegal_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(ILLEGAL_ALIASES))
    phone_pattern: str = PHONE
    wechat_pattern: str = WECHAT
    qq_pattern: str = QQ
    suspicious_score: int = 45
    high_risk_score: int = 80
    group_limit_x_ratio: float = 2.2
    group_limit_y_ratio: float = 5.0
    region_padding_x_ratio: float = 0.18
    region_padding_y_ratio: float = 0.20
    min_region_padding: int = 12
    scores: Mapping[str, int] = field(default_factory=lambda: dict(SCORES))

    @classmethod
    def load(cls, path: str) -> RuleSet:
        """From a YAML file; keys it lacks keep their defaults, weights are merged."""
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        known = {f.name for f in fields(cls)}
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        for k in ("medical_aliases", "illegal_aliases"):
            if k in given:
                given[k] = {c: tuple(a) for c, a in given[k].items()}
        if "scores" in given:
            given["scores"] = SCORES | given["scores"]
        return cls(**given)

    def weight(self, name: str) -> int:
        return self.scores.get(name, SCORES[name])
