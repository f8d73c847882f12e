"""Word lists, patterns, limits and lookup tables that decide results.

They are plain configuration. Every operator takes them as keyword arguments, so another
language or market only needs other values.
"""

from __future__ import annotations

LOCAL_ZONE = "Asia/Seoul"
LOCAL_OFFSET = "+09:00"

# Retrieval --------------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
RELEVANCE_FLOOR = 0.5
SCORE_DIGITS = 6
MAX_TOP_K = 10
TITLE_WEIGHT = 2
RETRIEVAL_TOKEN = "[가-힣]+|[a-z0-9]+"
GENERIC_QUERY_TOKENS = ["최근", "설명", "알려", "알려줘", "주세요", "자료", "정보", "관련", "어때", "대해"]
REQUEST_ENDINGS = ["해주세요", "주세요", "해줘", "해요", "줘", "해"]
RETRIEVAL_PARTICLES = [
    "으로부터", "에서부터", "에게서", "으로", "에서", "에게", "께서", "부터", "까지", "은", "는", "이", "가",
    "을", "를", "와", "과", "의", "에", "로", "도", "만",
]
DOCUMENT_TYPE_KEYS = ["document_type", "report_type", "content_level"]

# Freshness --------------------------------------------------------------------------------
MAX_AGE_DAYS = {"news": 30, "disclosure": 180, "research_report": 180}
DISCLOSURE_FALLBACK_DAYS = 365
MIN_DISCLOSURES = 5
STALE_AFTER_DAYS = {"news": 14, "research_report": 180}
WARNING_ORDER = [
    "missing_published_at", "future_published_at", "stale_news", "stale_research_report",
    "disclosure_window_extended", "insufficient_disclosure_coverage", "unresolved_disclosure_correction",
]
LIMITING_WARNINGS = [
    "stale_news", "stale_research_report", "insufficient_disclosure_coverage", "unresolved_disclosure_correction",
]

# Planning ---------------------------------------------------------------------------------
# intent -> (required sources, required evidence, needs a security)
INTENT_MATRIX = {
    "financial_term": (["glossary"], ["definition"], False),
    "disclosure_summary": (["disclosure"], ["disclosure"], True),
    "research_report_summary": (["research_report"], ["research_report"], True),
    "recent_issue": (["news"], ["recent_news"], True),
    "risk_factors": (
        ["news", "disclosure", "research_report"], ["risk", "recent_news", "disclosure", "research_report"], True,
    ),
    "multi_source_summary": (
        ["news", "disclosure", "research_report"], ["recent_news", "disclosure", "research_report"], True,
    ),
    "price": ([], [], True),
    "price_move": (
        ["news", "disclosure", "research_report"], ["recent_news", "disclosure", "research_report"], True,
    ),
}
# Only the news source counts towards coverage of a price-move answer.
COVERAGE_SOURCES = {"price_move": ["news"]}
PHRASES = {
    "prohibited": [
        "사도 돼", "사야", "팔아", "팔까", "매수해", "매수해야", "매수할까", "매수 추천", "매도해", "매도해야",
        "매도할까", "매도 추천", "계속 보유", "보유해야", "목표가 얼마", "목표가 알려", "목표가 제시", "손절해야",
        "손절할까", "손절 시점", "손절 가격", "익절해야", "익절할까", "익절 시점", "익절 가격", "내일 오를까",
        "내일 떨어질까", "오를 확률", "떨어질 확률", "상승 확률", "하락 확률", "확정 수익",
    ],
    "price_move": [
        "왜 올랐", "왜 내렸", "왜 떨어", "왜 상승", "왜 하락", "왜 움직", "주가 이유", "상승 이유", "하락 이유",
        "오른 이유", "내린 이유", "주가 배경", "상승 배경", "하락 배경",
    ],
    "price": [
        "현재 주가", "지금 주가", "오늘 주가", "주가 알려", "주가 얼마", "주가 어때", "주식 어때", "가격 알려",
        "가격 얼마", "얼마", "올랐어", "내렸어", "상승했", "하락했",
    ],
    "unsupported_market": ["주가 추이", "가격 추이", "수익률", "차트"],
    "term_cue": ["뭐야", "무엇", "뜻", "정의", "설명", "용어"],
    "term_marker": [
        "per", "pbr", "roe", "eps", "시가총액", "매출", "영업이익", "영업이익률", "순이익", "시총", "유상증자",
        "전환사채", "공시", "컨센서스", "연결재무제표", "별도재무제표",
    ],
    "risk": ["위험 요인", "위험", "리스크", "우려", "악재", "불확실성", "조심할 점"],
    "multi_source": [
        "종합", "여러 자료", "전체 자료", "뉴스와 공시", "뉴스와 리포트", "공시와 리포트", "한번에 요약",
    ],
    "disclosure": ["정정공시", "사업보고서", "반기보고서", "분기보고서", "공시"],
    "research_report": ["리서치", "증권사 리포트", "애널리스트 리포트", "리포트", "투자의견 보고서"],
    "recent_issue": [
        "최근 이슈", "최근 뉴스", "최신 소식", "최근 소식", "뉴스 이슈", "주요 이슈", "이슈", "뉴스", "무슨 일",
    ],
    "issue": ["이슈"],
    "recency": ["최근", "최신", "뉴스", "소식", "요즘"],
    "positive": [
        "호재", "긍정 요인", "긍정적", "좋은 점", "성장 동력", "기대 요인", "기대할 만한", "촉매", "모멘텀",
    ],
    "performance": ["실적", "매출", "영업이익", "순이익", "현금흐름", "재무", "돈은 잘 벌", "돈을 잘 벌"],
    "business": [
        "뭐 하는 회사", "무엇을 하는 회사", "어떤 회사", "주력 사업", "주요 사업", "사업 구조", "주요 제품",
        "어떤 제품", "뭘 만들",
    ],
    "technology": ["기술", "연구개발", "핵심 제품", "hbm", "반도체", "로봇", "전기차"],
    "outlook": ["전망", "앞으로", "예상", "향후"],
    "shareholder_return": ["배당", "주주환원", "자사주"],
    "balanced": ["장단점", "좋은 점과 나쁜 점", "긍정과 위험", "호재와 악재"],
    "situation": ["상황", "어때"],
    "follow_up": [
        "그럼", "그러면", "이어서", "계속 알려", "같은 기간", "그 기간", "해당 기간", "그중", "그 내용", "그 자료",
    ],
    "same_period": ["기간"],
    "today": ["오늘"],
    "recent": ["최근"],
    "route_recency": ["최근", "오늘", "요즘", "현재"],
    "price_word": ["주가"],
}
# Matched only between characters that are neither digits, Latin nor Hangul letters.
BOUNDED_PHRASES = ["사야"]
SWITCH_REMAINDERS = ["은", "는", "은요", "는요", "도", "도요", "쪽은", "쪽은요"]
CANDIDATE_PARTICLES = ["에서", "은", "는", "이", "가", "을", "를", "와", "과", "에", "의"]
CANDIDATE_PUNCTUATION = ".,;:!?()[]{}\"'`"
CANDIDATE_ENGLISH_HINTS = ["samsung", "electronics", "sk", "hynix", "hyundai", "motor"]
CANDIDATE_TERM_MARKERS = ["PER", "PBR", "ROE", "EPS"]
CANDIDATE_DOMAIN_TOKENS = ["HBM"]
FOREIGN_TICKER_UPPER = r"^[A-Z]{1,5}([.\-][A-Z])?$"
FOREIGN_TICKER_FOLDED = r"^[a-z]{1,5}([.\-][a-z])?$"
SOURCE_MARKERS = {
    "news": ["뉴스", "기사", "보도"],
    "disclosure": ["공시", "dart", "분기보고서", "반기보고서", "사업보고서"],
    "research_report": ["리포트", "증권사 보고서", "증권사 자료"],
}
FOCUS_QUERY_TERMS = {
    "general": ["최근", "이슈", "실적", "매출", "영업이익", "전망", "위험", "기술", "배당"],
    "recent_events": ["최근", "이슈", "뉴스", "보도", "실적", "전망"],
    "positive": ["기대", "성장", "수요", "공급", "계약", "기술", "배당", "주주환원", "모멘텀"],
    "risk": ["위험", "리스크", "우려", "변동성", "둔화", "하락", "불확실성"],
    "performance": ["실적", "매출", "영업이익", "순이익", "현금흐름", "가이던스"],
    "business": ["사업", "부문", "제품", "매출", "생산", "수주"],
    "technology": ["기술", "제품", "연구개발", "특허", "HBM", "로봇", "전기차"],
    "outlook": ["전망", "예상", "가이던스", "촉매", "위험", "불확실성"],
    "shareholder_return": ["배당", "주주환원", "자사주", "현금흐름"],
    "disclosure": ["공시", "분기보고서", "사업보고서", "실적", "위험"],
    "research_view": ["리포트", "전망", "예상", "목표", "촉매", "위험"],
    "balanced": ["실적", "호재", "위험", "전망", "기술", "배당"],
    "term": [],
    "price": [],
    "price_move": [
        "가격", "상승", "하락", "배경", "뉴스", "공시", "전망", "위험", "HBM", "반도체", "수주", "공급", "실적",
        "제품", "기술", "투자", "생산", "판매", "동맹", "지분",
    ],
}

# Answer limits and order ------------------------------------------------------------------
SHORT_DISCLOSURE_MARKERS = ["핵심", "요점", "다시"]
EASY_MARKERS = ["쉽게"]
SHORT_MARKERS = ["핵심", "요점", "간단", "짧게", "쉽게", "다시"]
FOCUS_LIMITS = {
    "recent_events": 4, "performance": 4, "disclosure": 4,
    "positive": 5, "risk": 5, "outlook": 5, "shareholder_return": 5,
}
CATEGORY_PRIORITY = {
    "consolidated_revenue": 0, "consolidated_operating_profit": 1, "net_income_or_equivalent": 2,
    "production_or_sales": 3, "capex": 4, "research_and_development": 5,
    "financial_position_or_cashflow_or_debt": 6, "risk_or_uncertainty": 9,
}
OTHER_CATEGORY_PRIORITY = 7
OVERVIEW_MARKERS = ["주요 위험", "촉매", "전망", "평가", "핵심"]
CALM_RISK_PHRASES = ["우려가 제한", "위험이 제한", "훼손 우려가 제한"]
RISK_WORDS = ["위험", "우려", "둔화", "변동성", "불확실", "부담", "차질", "관세", "환율"]
HEDGE_MARKERS = ["확인해야", "확인할 필요", "함께 봐야", "단정", "달라질 수", "변동 요인", "변수"]

# Context budget ---------------------------------------------------------------------------
BUDGET_MAX_ROWS = 10
BUDGET_PER_SOURCE = 4
BUDGET_MAX_CHARS = 12_000
BUDGET_MAX_TOKENS = 6_000
MEMORY_CHARS = 2_000
CONTEXT_EXCHANGES = 2
CONTEXT_CHARS = 4_000
KEPT_EXCHANGES = 4

# Claims and citations ---------------------------------------------------------------------
GROUNDING_TOKEN = "[가-힣]{2,}|[a-z0-9]{2,}"
GROUNDING_PARTICLES = [
    "에게서", "으로부터", "이라도", "에서는", "으로는", "로부터", "까지", "부터", "에게", "처럼", "보다", "으로",
    "에서", "께서", "이라", "라고", "이며", "에는", "로는", "은", "는", "이", "가", "을", "를", "의", "에", "와",
    "과", "도", "만", "로",
]
GENERIC_GROUNDING_TOKENS = [
    "현재", "자료", "근거", "관련", "대한", "있습니다", "있다", "입니다", "한다", "보도", "공시", "리포트", "전망",
    "최근", "회사", "상황", "영향", "확인", "필요", "의미", "요인", "흐름", "보인다", "보입니다", "나타났다",
    "받고", "받을",
]
GROUNDING_MIN_SHARED = 2
GROUNDING_MIN_COVERAGE = 0.30
REJECTION_ORDER = [
    "unknown_evidence", "wrong_company", "invalid_locator", "unsafe_source_url", "unsupported_claim",
]
PAGE_BASES_WITH_NUMBER = ["pdf_1_based", "printed_page"]
PAGE_BASES_WITHOUT_NUMBER = ["source_section_only"]
OPAQUE_ASSET_ID = r"^[A-Za-z0-9._-]+$"
CREDENTIAL_KEYS = [
    "accesstoken", "apikey", "authorization", "authtoken", "bearertoken", "clientsecret", "credential",
    "opendartapikey", "secret", "signature", "token", "xamzsignature", "xapikey",
]
FORBIDDEN_PUBLIC_KEYS = [
    "description", "evidence_excerpt", "local_path", "page_text", "pages", "pdf_bytes", "raw", "raw_text",
    "source_file", "source_pdf", "text",
]
DISCLOSURE_VIEWER = "https://dart.fss.or.kr/dsaf001/main.do?rcpNo="
# One of these stands in every folded text that the pattern of the same name matches.
UNSAFE_ANSWER_STEMS = {
    "direct_action": ["사세요", "파세요", "보유", "매수", "매도", "buy", "sell", "hold"],
    "target_price": ["목표", "target"],
    "exit_timing": ["손절", "익절", "stop", "take"],
    "guarantee": ["보장", "확정", "틀림없이", "무조건", "guarantee"],
}
UNSAFE_ANSWER_PATTERNS = {
    "direct_action": (
        r"(?i)(?:사세요|파세요|보유하세요|(?:매수|매도|보유).{0,16}(?:하세요|해야|권장|추천)"
        r"|(?:buy|sell|hold).{0,16}(?:now|should|recommend))"
    ),
    "target_price": r"(?i)(?:목표가|목표\s*가격|target\s*price).{0,24}(?:\d|제시|설정|도달)",
    "exit_timing": (
        r"(?i)(?:손절|익절|stop[- ]?loss|take[- ]?profit).{0,24}(?:\d|가격|시점|하세요|해야|권장|추천)"
    ),
    "guarantee": (
        r"(?i)(?:보장(?:된다|됩니다|한다|합니다)|확정\s*수익|틀림없이|무조건|guaranteed?\s+return)"
    ),
    "future_certainty": (
        r"(?i)(?:확실히|반드시|분명히).{0,24}(?:상승|하락|오른|내린|개선|성장|달성)"
        r"|(?:상승|하락|오를|내릴).{0,16}(?:것이\s*확실|확정)"
    ),
    "direction_probability": r"(?i)(?:상승|하락|오를|내릴|급등|급락).{0,24}[-+]?\d+(?:\.\d+)?\s*%",
    "user_inference": (
        r"(?i)(?:사용자님|고객님|귀하|당신).{0,24}(?:보유|매수|매입|평단|손실|수익|포트폴리오|투자\s*성향"
        r"|위험\s*성향|투자\s*목표)|(?:보유하고\s*계신|매수하신|매입하신|투자하고\s*계신|손실\s*중이신"
        r"|평단(?:은|이)|(?:보유|매수|매입|투자)\s*(?:하신|하셨|중이신))"
    ),
    "conflict_conclusion": (
        r"(?i)(?:기사|자료|근거).{0,16}(?:수가\s*더\s*많|개수가\s*더\s*많|과반|다수이므로)"
        r"|(?:긍정|부정|상승|하락).{0,16}(?:우세|승리|더\s*많으므로)|(?:감성|sentiment)\s*(?:점수|score)"
        r"|종합하면.{0,24}(?:매수|매도|상승|하락|긍정|부정)"
    ),
}
NUMERIC_TOKEN = (
    r"(?i)(?<![\dA-Za-z_.])(?:\d{4}-\d{2}-\d{2}|\d{4}년\s*\d{1,2}월(?:\s*\d{1,2}일)?|\d{4}년\s*[1-4]분기"
    r"|(?:(?:KRW|USD|EUR|JPY|₩|\$|€|¥)\s*)?[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
    r"(?:\s*(?:%p|%|조원|억원|만원|천원|원|배|주|년|개월|일))?)(?![\dA-Za-z_.])"
)
AMOUNT_UNITS = {"백만원": 1_000_000, "억원": 10_000}
AMOUNT_PATTERN = r"(?<![\d,])(\d{1,3}(?:,\d{3})+|\d+)(백만원|억원)"
AMOUNT_ORIGINAL_MARK = "원문"
ANSWER_SECTIONS = [
    "summary", "facts", "interpretation", "inference", "positive_factors", "risk_factors", "uncertainty",
]
MEMORY_SECTIONS = [
    "summary", "facts", "risk_factors", "uncertainty", "interpretation", "inference", "positive_factors",
]
OVERCLAIM_PHRASES = ["무조건 저평가", "반드시 상승", "확실한 수익", "always undervalued", "guaranteed return"]

# Feeds and disclosures --------------------------------------------------------------------
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
TRACKING_PREFIX = "utm_"
STATUS_CODES = {
    "000": "ok", "013": "no_data",
    "010": "unauthorized", "011": "unauthorized", "012": "unauthorized", "101": "unauthorized",
    "901": "unauthorized",
    "020": "rate_limited", "021": "invalid_query", "100": "invalid_query",
    "014": "provider_unavailable", "800": "provider_unavailable", "900": "provider_unavailable",
}
CORRECTION_MARKERS = ["기재정정", "첨부정정"]
UPDATE_MARKERS = ["첨부추가", "변경등록", "연장결정", "발행조건정정"]
CORRECTION_ORDER_MARKER = "정정명령부과"
CORRECTION_REQUEST_MARKER = "정정제출요구"
SUBSEQUENT_CORRECTION_REMARK = "정"
WITHDRAWN_REMARK = "철"
WITHDRAWN_NAME = "철회"
LINEAGE_PREFIX = (
    r"^(?:\[(?:기재정정|첨부정정|첨부추가|변경등록|발행조건확정|정정명령부과|정정제출요구|정정|철회|연장결정)\]\s*)+"
)
CORRECTION_PREFIX = (
    r"^(?:\[(?:기재정정|첨부정정|첨부추가|변경등록|발행조건확정|정정명령부과|정정제출요구|정정)\]\s*)+"
)
REPORT_CATEGORIES = [
    ("periodic", ["사업보고서", "반기보고서", "분기보고서"]),
    ("material_event", [
        "주요사항보고서", "수시공시", "공정공시", "영업실적", "매출액또는손익구조", "단일판매", "공급계약", "시설투자",
        "유형자산", "타법인주식", "배당",
    ]),
    ("securities", [
        "증권신고서", "투자설명서", "주식매수선택권", "유상증자", "무상증자", "전환사채", "신주인수권",
    ]),
    ("ownership", ["임원ㆍ주요주주", "대량보유", "최대주주", "소유상황"]),
]
DESCRIPTION_ALIAS_MAX_OFFSET = 100
CURATION_ALIAS_MAX_OFFSET = 14
DAILY_CAP = 15
PERIOD_CAP = 60
CURATION_EVENT_TERMS = [
    "실적", "매출", "영업이익", "공급", "계약", "수주", "투자", "HBM", "반도체", "파업", "생산", "판매", "전기차",
    "로봇", "배당", "공시", "리콜", "관세", "환율", "AI", "메모리", "스마트폰", "아이폰", "지분", "인수",
    "최대주주", "신제품", "출시", "양산", "개발", "파트너십", "동맹", "수익성", "영업이익률", "사전 판매",
]
BROAD_MARKET_TERMS = ["코스피", "코스닥", "증시", "시황", "마감", "상한가"]
REJECT_TERMS = [
    "레버리지", "ETF", "삼성전자우", "대학생", "일하고 싶은 기업", "구직자", "교육 지원", "직무훈련", "아카데미",
    "정상회의", "장학", "특징주", "자사주 매입", "촉구", "오늘 뭐했니", "오늘과 내일",
]
CATEGORY_LABELS = {
    "capex": "시설투자",
    "consolidated_operating_profit": "영업이익 실적",
    "consolidated_revenue": "매출 실적",
    "contract_or_business_plan": "계약 사업계획",
    "financial_position_or_cashflow_or_debt": "재무현황 현금흐름 부채",
    "major_product_or_technology": "주요제품 기술",
    "major_segment_profit": "사업부문 수익성",
    "major_segment_revenue": "사업부문 매출",
    "net_income_or_equivalent": "순이익 실적",
    "production_or_sales": "생산 판매",
    "research_and_development": "연구개발",
    "risk_or_uncertainty": "위험 불확실성",
}

# Events -----------------------------------------------------------------------------------
EVENT_GAP_SECONDS = 36 * 3600
EVENT_TOKEN = "[A-Za-z][A-Za-z0-9.+-]*|[가-힣]{2,}"
EVENT_STOP_WORDS = [
    "삼성전자", "sk하이닉스", "하이닉스", "현대차", "현대자동차", "관련", "대한", "으로", "에서", "한다", "전망",
    "주가", "증시", "코스피", "기업", "시장", "올해", "내년", "한국", "국내", "글로벌", "가능성", "강화", "본격",
]
EVENT_PHRASES = {
    "hbm5": "hbm5", "hbm4": "hbm4", "2나노": "2나노", "2분기": "2분기", "3분기": "3분기", "실적": "실적",
    "로봇": "로봇", "피지컬 ai": "피지컬ai", "관세": "관세", "생산차질": "생산차질", "생산 차질": "생산차질",
    "생산중단": "생산중단", "생산 중단": "생산중단", "배당": "배당", "자사주": "자사주", "adr": "adr",
    "구글": "구글", "아이폰": "아이폰", "파운드리": "파운드리", "브로드컴": "브로드컴", "반도체": "반도체",
    "fomc": "fomc", "엔비디아": "엔비디아", "웨이모": "웨이모", "보스턴다이내믹스": "보스턴다이내믹스",
    "파업": "파업", "목표가": "목표가", "etf": "etf", "d램": "d램", "메모리": "메모리",
}
EVENT_DISTINCTIVE = [
    "hbm5", "hbm4", "2나노", "2분기", "로봇", "피지컬ai", "관세", "생산차질", "생산중단", "배당", "자사주", "adr",
    "구글", "아이폰", "파운드리", "브로드컴", "fomc", "엔비디아", "웨이모", "보스턴다이내믹스", "파업", "목표가",
    "etf", "d램",
]
CLUSTER_TERM_LIMIT = 30
COMPARISON_ARTICLES_SHOWN = 20
PERSPECTIVE_LIMIT = 3
DISCLOSURE_LINK_LIMIT = 2
COVERAGE_ARTICLE_LIMIT = 4
CATEGORY_TOPICS = {
    "consolidated_revenue": ["실적", "매출"],
    "consolidated_operating_profit": ["실적", "영업이익"],
    "major_segment_revenue": ["실적", "매출"],
    "major_segment_profit": ["실적", "영업이익"],
    "contract_or_business_plan": ["수주", "계약", "사업"],
    "major_product_or_technology": ["기술", "제품"],
    "production_or_sales": ["생산", "판매"],
    "capex": ["투자", "시설투자", "생산"],
    "risk_or_uncertainty": ["위험", "불확실성"],
    "shareholder_return": ["배당", "자사주", "주주환원"],
}
FACT_TOPIC_PHRASES = {
    "hbm4": "hbm4", "hbm5": "hbm5", "d램": "d램", "dram": "d램", "lpddr": "d램", "반도체": "반도체",
    "foundry": "파운드리", "파운드리": "파운드리", "tesla": "테슬라", "전기차": "전기차", "전동화": "전기차",
    "로봇": "로봇", "관세": "관세", "환율": "환율", "통화": "환율", "배당": "배당", "자기주식": "자사주",
    "자사주": "자사주", "생산중단": "생산중단", "생산 중단": "생산중단", "생산차질": "생산차질",
    "생산 차질": "생산차질", "시설투자": "시설투자", "시설 투자": "시설투자", "adr": "adr",
}
QUARTER_TOPIC = r"\d분기"
GENERIC_LINK_TOPICS = [
    "ai", "규모", "기술", "달러", "매출", "메모리", "반도체", "분기", "파운드리", "사업", "생산", "수급", "실적",
    "영업이익", "위험", "전망", "제품", "투자",
]
EVENT_QUERY_TOKEN = r"[A-Za-z][A-Za-z0-9.+-]*|[가-힣]{2,}|\d+(?:\.\d+)?"
EVENT_QUERY_STOP_WORDS = [
    "삼성전자", "하이닉스", "sk하이닉스", "현대차", "현대자동차", "최근", "오늘", "이슈", "뉴스", "호재", "악재",
    "주가", "상승", "하락", "이유", "원인", "상황", "알려줘", "해줘", "관련", "대한", "근거", "대조", "대조해줘",
    "비교", "비교해줘", "반복", "기사", "보도",
]
EVENT_QUERY_MARKERS = [
    "최근", "이슈", "뉴스", "호재", "악재", "오늘", "왜", "원인", "상황", "오른", "올랐", "떨어", "하락", "상승",
]
EVENT_LABEL_TOKEN = "(?i)[A-Za-z][A-Za-z0-9.+-]{2,}|[가-힣0-9]{2,}"
EVENT_LABEL_GENERIC = [
    "삼성전자", "sk하이닉스", "하이닉스", "현대차", "현대자동차", "최근", "뉴스", "기사", "보도", "사건", "이슈",
    "관련", "핵심", "요약", "적용", "속도", "향상", "전망", "실적", "기술",
]
TITLE_TOPICS = [
    ("영업(잠정)실적", ["실적", "2분기", "매출", "영업이익"]),
    ("배당", ["배당", "주주환원"]),
    ("자기주식", ["자사주", "주주환원", "수급"]),
    ("생산중단", ["생산중단", "생산차질", "생산"]),
    ("시설투자", ["시설투자", "투자", "생산", "반도체"]),
    ("풍문또는보도", ["보도", "이슈"]),
    ("최대주주", ["지분", "수급"]),
]

# Market -----------------------------------------------------------------------------------
SESSION_EDGES = [("08:50:00", "pre_market"), ("15:20:00", "regular"), ("20:00:00", "after_market")]
MARKET_CLOSE = "20:00:00"
PRICE_TOLERANCE = "0.000001"

REQUIRED_FACT_CATEGORIES = [
    "consolidated_revenue", "consolidated_operating_profit", "net_income_or_equivalent", "major_segment_revenue",
    "major_segment_profit", "production_or_sales", "capex", "research_and_development",
    "financial_position_or_cashflow_or_debt", "risk_or_uncertainty",
]
OPTIONAL_FACT_CATEGORIES = ["contract_or_business_plan", "major_product_or_technology"]
FACT_CONFIDENCE = ["high", "medium"]
FACT_VERIFIED = "verified_against_source"
FACT_VERIFIED_WITH_NOTE = "verified_against_source_with_conflict_note"
MIN_FACTS = 10
GLOSSARY_SECTIONS = ["definition", "why_it_matters", "caution", "formula", "example"]
GLOSSARY_PARTICLES = ["에서", "으로", "은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "로"]
MARKET_STRATEGY_MARKERS = ["etp", "msci"]
MIN_REPORT_SECTIONS = 8
PROVIDER_STATUSES = [
    "ok", "no_data", "provider_unavailable", "rate_limited", "unauthorized", "invalid_query", "parse_error",
    "timeout",
]
DECISION_STATUSES = ["complete", "partial", "no_evidence", "provider_failed", "blocked"]
ROUTING_MODES = ["deterministic", "hybrid_llm", "hybrid_fallback", "cached"]
CLASSIFIER_STATUSES = [
    "not_called", "accepted", "timeout", "rate_limited", "authentication_error", "provider_unavailable",
    "invalid_response", "content_blocked",
]

# Requests ---------------------------------------------------------------------------------
ADMISSION_WINDOW_SECONDS = 300
ADMISSION_WINDOW_LIMIT = 10
ADMISSION_DAY_LIMIT = 50
ADMISSION_GLOBAL_DAY_LIMIT = 100
REPEAT_TTL_SECONDS = 90
SESSION_GAP_SECONDS = 1800

# Evaluation -------------------------------------------------------------------------------
HELD_OUT_PASS_RATE = 0.8
AGREEMENT_MINIMUM = 5
NO_PASS_THRESHOLD = 1.000001
REPORT_STALE_DAYS = 180
COVERAGE_READY = {"total": 5, "pre_market": 1, "intraday": 2}

# What marks a path of a local machine in a text: drive, network share, slashed host, file URL, absolute path.
LOCAL_PATH_PATTERNS = [
    r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/]",
    r"\\\\[^\\/\s]+[\\/][^\\/\s]+",
    r"(?<![A-Za-z0-9_:])//[^/\s]+/[^/\s]+",
    r"(?i:file://)",
    r"(?:^|[\s\"'()=\[\]{},;])/(?![/\s])",
]
