"""What events of each family are made of. Words are compared without blanks and punctuation."""

#: Cells that say nothing, keys of formalities, and marks of corrections; neither makes a fact.
NOTHING = ("", "-", "--")
FORMALITIES = ("사외이사참석여부", "감사참석여부", "감사(사외이사가아닌감사위원)참석여부", "작성책임자")
CORRECTIONS = ("정정관련공시서류", "정정사유", "정정사항")

#: Keys whose value dates an event, first the most telling, by subtype; other subtypes take GENERIC_DATES.
DATES = {
    "단일판매ㆍ공급계약체결": ("계약수주일자", "계약수주일"),
    "단일판매ㆍ공급계약해지": ("해지일자",),
    "신규시설투자등": ("이사회결의일결정일",),
    "투자판단관련주요경영사항": ("이사회결의일결정일또는사실확인일", "사실발생확인일", "결정일"),
    "자기주식처분결정": ("처분결정일",),
    "자기주식취득결정": ("취득결정일",),
    "자기주식취득신탁계약체결결정": ("이사회결의일결정일", "계약체결예정일자"),
    "자기주식취득신탁계약해지결정": ("이사회결의일결정일", "해지예정일자"),
    "유상증자결정": ("이사회결의일결정일",),
    "무상증자결정": ("이사회결의일결정일",),
    "감자결정": ("이사회결의일결정일",),
    "상각형조건부자본증권발행결정": ("이사회결의일결정일",),
    "전환사채권발행결정": ("이사회결의일결정일",),
    "교환사채권발행결정": ("이사회결의일결정일",),
    "자본으로인정되는채무증권발행결정": ("이사회결의일결정일",),
    "자기전환사채매도결정": ("매도결정일",),
    "제3자의전환사채매수선택권행사": ("전환사채매수선택권행사일",),
    "타법인주식및출자증권양수결정": ("이사회결의일결정일", "양수예정일자"),
    "타법인주식및출자증권양도결정": ("이사회결의일결정일", "양도예정일자"),
    "유형자산양수결정": ("이사회결의일결정일", "계약체결일"),
    "유형자산양도결정": ("이사회결의일결정일", "계약체결일"),
    "회사합병결정": ("이사회결의일결정일", "합병계약일"),
    "회사분할결정": ("이사회결의일",),
    "회사분할합병결정": ("이사회결의일결정일", "분할합병계약일"),
    "주식교환·이전결정": ("이사회결의일결정일", "교환이전계약일"),
    "주식교환ㆍ이전결정": ("이사회결의일결정일", "교환이전계약일"),
    "영업양수결정": ("이사회결의일결정일", "계약체결일"),
    "소송등의제기": ("확인일자", "제기일자"),
    "영업정지": ("이사회결의일결정일", "영업정지일자"),
    "해외증권시장주권등상장폐지결정": ("이사회결의일확인일", "폐지예정일자"),
    "해외증권시장주권등상장폐지": ("확인일자", "매매거래종료일"),
    "해외증권시장주권등상장결정": ("이사회결의일결정일", "상장예정일자"),
    "해외증권시장주권등상장": ("확인일자", "상장일자"),
}
GENERIC_DATES = ("이사회결의일결정일", "이사회결의일", "사실발생확인일", "사실확인일", "확인일자", "결정일")

#: Keys whose facts come first in an event's content, by family; `generic` has none.
KEYWORDS = {
    "generic": (),
    "contract": ("체결계약명", "판매ㆍ공급계약구분", "계약금액", "계약상대", "판매ㆍ공급지역", "계약기간", "계약수주일", "주요계약조건", "공시유보", "기타투자판단"),
    "contract_termination": ("해지구분", "해지금액", "계약상대", "해지주요사유", "해지일자", "계약기간", "기타투자판단"),
    "management_judgment": ("제목", "주요내용", "임상시험", "시험결과", "사실발생확인일", "이사회결의일결정일또는사실확인일", "향후계획", "투자유의사항", "기타투자판단"),
    "facility_investment": ("투자구분", "투자대상", "투자금액", "자기자본대비", "투자목적", "투자기간", "이사회결의일", "기타투자판단"),
    "capital_securities": ("발행", "증자", "사채", "주식수", "발행가액", "자금조달목적", "자금의사용목적", "배정", "전환", "교환", "청약", "납입일", "이사회결의일"),
    "treasury_stock": ("취득예정주식", "처분예정주식", "취득예정금액", "처분예정금액", "계약금액", "취득목적", "처분목적", "취득방법", "처분방법", "계약기간", "결정일"),
    "asset_transaction": ("양수", "양도", "투자대상", "투자금액", "거래상대방", "목적", "예정일자", "이사회결의일", "기타투자판단"),
    "corporate_restructuring": ("합병방법", "분할방법", "교환이전", "상대방", "합병비율", "분할비율", "목적", "계약일", "효력발생일", "일정", "이사회결의일", "기타투자판단"),
    "legal_risk": ("사건명", "원고", "피고", "청구내용", "청구금액", "영업정지", "영향", "대응", "제기일자", "확인일자", "이사회결의일"),
    "market_disclosure": ("증권시장", "상장", "상장폐지", "종목명", "주식수", "사유", "예정일", "확인일", "향후일정"),
}
#: The family of a subtype, else of a type, else generic.
FAMILY_OF_SUBTYPE = {"단일판매ㆍ공급계약체결": "contract", "단일판매ㆍ공급계약해지": "contract_termination", "신규시설투자등": "facility_investment", "투자판단관련주요경영사항": "management_judgment"}
FAMILY_OF_TYPE = {
    "계약·영업거래": "contract", "자본·증권발행": "capital_securities", "자기주식·주주환원": "treasury_stock", "투자·자산거래": "asset_transaction",
    "M&A·기업구조개편": "corporate_restructuring", "법률·규제·사고·리스크": "legal_risk", "시장·공시·해외": "market_disclosure",
}
