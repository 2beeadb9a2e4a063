"""Word lists, type maps and thresholds.

Fixed values: results depend on these words and numbers, so they are stated as they are.
"""

LINKABLE_TYPES = ("ORG", "GPE", "PERSON", "LOC")
PRONOUN_TYPES = ("PRON", "NOUN")
TYPE_MAP = {"ORGANIZATION": "ORG", "ORG": "ORG", "nt": "ORG", "PERSON": "PERSON", "nr": "PERSON", "LOCATION": "GPE", "LOC": "GPE", "ns": "GPE", "GPE": "GPE"}

ORG_ANAPHORS = ("该公司", "这家公司", "本公司", "该集团", "该企业", "这家企业", "该机构", "该单位", "该校", "该院", "该局", "其", "它")
PERSON_ANAPHORS = ("他", "她", "他们", "她们", "本人", "该负责人", "该专家")
COLLECTIVE_ANAPHORS = (
    "两家公司", "两家企业", "两家机构", "两家央企", "两家高校", "两所高校", "两所大学", "这些企业", "这些机构", "多家企业", "多家机构",
    "上述企业", "上述机构", "上述银行", "双方", "二者", "两者", "该二者", "三方", "各方", "上述单位", "两人", "两地", "两款应用", "它们", "他们", "她们",
)
CONJUNCTIONS = ("和", "与", "及", "以及", "、", "同", "跟", "连同", "会同")
EXACTLY_TWO = ("双方", "二者", "两者", "该二者", "两家公司", "两家企业", "两家机构", "两家央企", "两家高校", "两所高校", "两所大学", "两人", "两地", "两款应用")
EXACTLY_THREE = ("三方",)
ORDINALS = {"前者": 0, "后者": 1}
SWITCH_TERMS = ("随后", "转由", "转而", "改由", "接管", "负责", "宣布", "发布")
RESET_TERMS = ("与此同时", "另一方面", "项目转向", "另行启动", "转而", "改由")
MAX_EVIDENCE = 2

EXACT_SCORE = 0.95
FUZZY_BASE, FUZZY_RATIO, FUZZY_SIMILARITY = 0.35, 0.35, 0.30
MIN_FUZZY_LENGTH, MIN_FUZZY_RATIO = 3, 0.5
NIL_THRESHOLD, LLM_TRIGGER, TOP_K = 0.90, 0.65, 10
COREF_THRESHOLD, MAX_SENTENCE_GAP = 0.55, 3

TYPE_PRIORITY = {"ORG": 3, "GPE": 3, "PERSON": 3, "LOC": 2, "UNKNOWN": 1}
SOURCE_PRIORITY = {"msra": 3, "ontonotes": 2, "pku": 1}

#: Characters that count as white space in texts.
SPACE_CLASS = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SENTENCE_END = "[。！？!?]"

TYPE_DISPLAY = {
    "ORG": "组织机构", "GPE": "地理政治实体（国家/城市/地区）", "PERSON": "人物", "LOC": "地理位置（山川/河流/景点）",
    "GRID_COMPANY": "电网企业（电力输配）", "POWER_GENERATOR": "发电企业（电力生产）", "NEW_ENERGY_ENTERPRISE": "新能源企业（风电/光伏/储能）",
    "POWER_FACILITY": "电力设施（电站/变电站）", "TECHNICAL_TERM": "专业术语（电力/能源领域）", "RESEARCH_INSTITUTION": "研究机构",
    "TECH_COMPANY": "科技企业（信息技术/互联网）", "FINANCIAL_INSTITUTION": "金融机构（银行/证券/保险）", "AUTO_MANUFACTURER": "汽车制造商",
    "GOVERNMENT_AGENCY": "政府机构（部委/厅局）", "EDUCATIONAL_INSTITUTION": "教育机构（大学/研究院）", "CONSUMER_PRODUCT": "消费品品牌",
    "SOFTWARE_PLATFORM": "软件平台（互联网产品）", "ENERGY_ENTERPRISE": "能源企业（综合能源）", "STATE_ENTERPRISE": "国有企业（央企/地方国企）",
    "PRIVATE_ENTERPRISE": "民营企业", "FOREIGN_ENTERPRISE": "外资企业", "JOINT_VENTURE": "合资企业", "INDUSTRY_ASSOCIATION": "行业协会/组织",
    "STANDARD_BODY": "标准制定机构", "REGULATORY_AGENCY": "监管机构", "UNKNOWN": "未知类型",
}
ACTION_TERMS = ("成立", "发布", "宣布", "推出", "设立", "组建", "运营", "管理", "服务", "生产", "销售")
DATE_PATTERN = r"(\d{4}年|\d{1,2}月|\d{1,2}日|近期|最近|此前)"
DOMAIN_CLUES = {
    "公司": "企业/公司", "集团": "企业集团", "电网": "电力企业", "电力": "电力行业", "能源": "能源行业", "科技": "科技企业", "研究": "研究机构",
    "大学": "教育机构", "政府": "政府机构", "国家": "国家级机构", "国际": "国际组织", "协会": "行业协会", "基金": "金融/基金", "银行": "金融机构",
    "证券": "金融机构", "保险": "金融机构", "汽车": "汽车制造", "智能": "科技/智能化", "数字": "数字化/科技", "数据": "数据/信息", "云": "云计算/科技",
    "AI": "人工智能/科技", "人工智能": "人工智能/科技", "5G": "通信/科技", "芯片": "半导体/科技",
}
