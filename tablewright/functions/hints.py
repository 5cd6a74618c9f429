"""Results depend on these exact words, orders and limits."""

# ---- fixed values: what a column name says about its content -------------
NAME_HINTS = {
    "phone": ["phone", "手机", "电话", "tel", "mobile", "contact"],
    "email": ["email", "邮箱", "mail"],
    "date": ["date", "日期", "时间", "time", "created", "updated"],
    "name": ["name", "姓名", "名称", "title", "标题"],
    "address": ["address", "地址", "addr", "location"],
}

# ---- fixed values: kinds of personal data, first match wins --------------
ID_CARD, PHONE, EMAIL, BANK_CARD, NAME, ADDRESS = "身份证号", "手机号", "邮箱", "银行卡", "姓名", "地址"
PERSONAL_HINTS = {
    ID_CARD: ["身份证", "id_card", "idcard", "证件号"],
    PHONE: ["phone", "手机", "电话", "tel", "mobile", "contact"],
    EMAIL: ["email", "邮箱", "mail"],
    BANK_CARD: ["bank", "银行卡", "card_no", "账号"],
    NAME: ["name", "姓名", "customer", "user", "客户"],
    ADDRESS: ["address", "地址", "addr", "location", "住址"],
}

# ---- fixed values: patterns (ASCII \d; \b and \w are made Unicode-aware by the caller) ----
ID_CARD_INSIDE = r"\b\d{17}[\dXx]\b"
MOBILE_INSIDE = r"\b1[3-9]\d{9}\b"
EMAIL_INSIDE = r"\b[\w.-]+@[\w.-]+\.\w+\b"
ID_CARD_START = r"^\d{17}[\dXx]"
ID_CARD_WHOLE = r"^\d{17}[\dXx]$"
PHONE_WHOLE = r"^1\d{10}$"
EMAIL_WHOLE = r"^[\w.-]+@[\w.-]+\.\w+$"

# ---- fixed values: address prefixes kept by the address mask, long forms first ----
ADDRESS_PREFIXES = [
    "北京市", "上海市", "天津市", "重庆市", "广东省", "浙江省", "江苏省", "山东省",
    "北京", "上海", "天津", "重庆", "广东", "浙江", "江苏", "山东",
]

# ---- fixed values: whole words replaced in a text key --------------------
ABBREVIATIONS = {
    "limited": "ltd", "corporation": "corp", "incorporated": "inc",
    "company": "co", "street": "st", "avenue": "ave",
    "北京市": "北京", "上海市": "上海", "广州市": "广州", "深圳市": "深圳",
}

# ---- fixed values: quality weights, limits, levels -----------------------
QUALITY_WEIGHTS = {
    "completeness": 0.25, "accuracy": 0.25, "consistency": 0.15,
    "timeliness": 0.10, "uniqueness": 0.15, "validity": 0.10,
}
QUALITY_THRESHOLDS = {"completeness": 95.0, "accuracy": 90.0, "consistency": 95.0, "uniqueness": 98.0}
MATURITY_LEVELS = [(95, "优化级(5)"), (85, "量化管理级(4)"), (70, "稳健级(3)"), (50, "受管理级(2)")]
MATURITY_FLOOR = "初始级(1)"
ASSET_GRADES = [(90, "A (卓越)"), (75, "B (良好)"), (60, "C (合格)"), (40, "D (待改进)")]
ASSET_FLOOR = "F (不合格)"
MODE_FILLED_COLUMNS = ["status", "category"]
FORMAT_COLUMNS = ["phone", "手机", "email", "邮箱", "id_card", "身份证"]

# ---- fixed values: industries, in the order that decides ties ------------
INDUSTRIES = {
    "工业": ["生产", "制造", "设备", "产线", "工艺", "零件", "装配"],
    "金融": ["银行", "交易", "贷款", "理财", "保险", "证券", "支付", "账户"],
    "电信": ["通信", "基站", "信号", "带宽", "运营商"],
    "交通": ["运输", "交通", "物流", "车辆", "航线", "港口"],
    "能源": ["电力", "石油", "天然气", "能源", "电网", "煤矿"],
    "医疗": ["患者", "病历", "诊断", "药品", "医院", "处方"],
    "教育": ["学生", "教师", "课程", "成绩", "学历"],
    "政务": ["政府", "行政", "审批", "公共", "户籍"],
}
GENERAL_INDUSTRY = "通用"
INDUSTRY_STANDARDS = {
    "工业": "SJ/T 12043-2025 工业数据分类分级指南",
    "金融": "JR/T 0197-2020 金融数据安全分级指南",
    "电信": "YD/T 4251-2023 电信大数据安全管控分类分级",
    "政务": "DB3212/T 1116-2022 政务数据安全分类分级指南",
    "能源": "DB14/T 3551-2025 能源数据安全保护分类分级指南",
    "医疗": "GB/T 39725-2020 健康医疗数据安全指南",
}
GENERAL_STANDARD = "GB/T 43697-2024 数据分类分级规则(通用)"

# ---- fixed values: field classes, first match wins -----------------------
FIELD_CLASSES = {
    "标识类": ["id", "编号", "代码", "code", "编码"],
    "名称类": ["name", "名称", "title", "标题", "姓名"],
    "联系信息类": ["phone", "电话", "mobile", "手机", "email", "邮箱", "address", "地址"],
    "时间类": ["date", "日期", "time", "时间", "created", "updated"],
    "金额类": ["amount", "金额", "price", "价格", "cost", "成本", "fee", "费用"],
    "状态类": ["status", "状态", "type", "类型", "category", "分类"],
    "描述类": ["desc", "描述", "remark", "备注", "note", "说明"],
}
OTHER_CLASS = "其他"

# ---- fixed values: field grades ------------------------------------------
CORE, IMPORTANT, GENERAL = "核心数据", "重要数据", "一般数据"
CORE_HINTS = ["身份证", "id_card", "idcard", "护照", "passport"]
IMPORTANT_HINTS = ["phone", "手机", "电话", "bank", "银行卡", "email", "邮箱"]

# ---- fixed values: columns whose format is checked -----------------------
DATE_FORMAT_HINTS = ["date", "日期", "time", "时间"]
PHONE_FORMAT_HINTS = ["phone", "手机", "mobile", "电话"]
DATE_FORMAT_ADVICE = "统一为 ISO 8601 格式 (YYYY-MM-DD)"
PHONE_FORMAT_ADVICE = "统一为11位数字 (如13800138000)"
CORE_FIELD_NOTE = "含核心数据字段，需重点保护"

# ---- fixed values: governance --------------------------------------------
STANDARD_NAMES = {
    "id": "标识符", "name": "名称", "phone": "联系电话", "mobile": "手机号码",
    "email": "电子邮箱", "address": "地址", "date": "日期", "time": "时间",
    "amount": "金额", "price": "单价", "quantity": "数量", "status": "状态",
    "create_time": "创建时间", "update_time": "更新时间",
}
TAG_HINTS = {
    "PII-potential": ["id", "编号", "code"],
    "PII": ["phone", "手机", "email", "邮箱"],
    "financial": ["amount", "金额", "price", "cost"],
    "temporal": ["date", "日期", "time", "时间"],
}
FRESHNESS_HINTS = ["date", "时间", "created", "updated"]
ACCURACY_PHONE = ["phone", "手机", "联系电话"]
ACCURACY_EMAIL = ["email", "邮箱", "邮件"]
ACCURACY_ID = ["id_card", "身份证"]
COMPLIANCE_PHONE = ["phone", "手机"]
COMPLIANCE_EMAIL = ["email", "邮箱"]
SENSITIVE_HIGH = ["id_card", "身份证", "passport"]
SENSITIVE_MEDIUM = ["phone", "手机", "email", "邮箱"]
CONTRACT_PHONE_RULE = r"pattern:^1\d{10}$"

# ---- fixed values: URLs and payloads -------------------------------------
PLATFORM_HOSTS = {
    "toutiao.com": "toutiao", "今日头条": "toutiao", "ixigua.com": "toutiao",
    "xiaohongshu.com": "xiaohongshu", "小红书": "xiaohongshu",
    "bilibili.com": "bilibili", "zhihu.com": "zhihu", "weibo.com": "weibo",
    "douyin.com": "douyin", "xueqiu.com": "xueqiu", "douban.com": "douban",
}
READERS = {
    "csv": "csv", "tsv": "csv", "xlsx": "excel", "xls": "excel", "json": "json", "jsonl": "json",
    "parquet": "parquet", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite",
}
LIST_KEYS = ["data", "items", "results", "list", "records"]
BLOCKED_HOSTS = (
    r"^(127\.|10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|0\.|::1|fe80:|fc00:)"
)
ARTICLE_URL = "https://www.toutiao.com/article/{}/"

# ---- fixed values: words of the repair report and of the notes on alignment ----
REPAIR_ISSUES = ("null_fill", "outliers", "format_violation")
REPAIR_TIERS = ("auto", "rule", "manual")
REPAIR_ACTIONS = (
    "fill_mode", "fill_median", "fill_by_business_rule", "manual_review: high null rate", "iqr_clip_or_flag",
    "manual_review: data integrity",
)
COVERAGE_NOTE = "分类覆盖率仅{}%"
FORMAT_ISSUES_NOTE = "个格式问题"

# ---- fixed values: words a SELECT text may not contain -------------------
FORBIDDEN_SQL = (
    r";|--|/\*|\*/|xp_|sp_|exec\s|execute\s|drop\s|alter\s|create\s|insert\s|update\s|delete\s"
    r"|truncate\s|grant\s|revoke\s"
)


def has_hint(name, hints):
    """True when any hint word occurs in the (lower-cased) column name."""
    lowered = name.lower()
    return any(h in lowered for h in hints)


def first_label(name, table, default=None):
    """First label of an ordered {label: hints} table whose hints occur in the name."""
    return next((label for label, hints in table.items() if has_hint(name, hints)), default)
