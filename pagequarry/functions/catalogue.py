"""Names of types and subjects, and how they map to one another. Rules that find a type in a text are a caller's data (operators.classify)."""

from __future__ import annotations

#: Types in the order that breaks ties, by area.
AREAS = {
    "공통수학": ["다항식", "방정식과 부등식", "행렬", "도형의 방정식", "집합과 명제", "함수와 그래프"],
    "대수·수학I": ["지수와 로그", "지수함수와 로그함수", "삼각함수", "수열"],
    "수학II·미적분": ["함수의 극한과 연속", "다항함수의 미분", "다항함수의 적분", "수열의 극한", "여러 가지 함수의 미분", "여러 가지 함수의 적분"],
    "확률과 통계": ["경우의 수", "확률", "통계"],
    "기하": ["이차곡선", "평면벡터", "공간도형과 공간좌표"],
}
TYPES = [t for of in AREAS.values() for t in of]
UNCLASSIFIED = "미분류"

_POWERS = ["지수와 로그", "지수함수와 로그함수", "삼각함수", "수열"]
_CALCULUS_1 = ["함수의 극한과 연속", "다항함수의 미분", "다항함수의 적분"]
_CALCULUS_2 = ["수열의 극한", "여러 가지 함수의 미분", "여러 가지 함수의 적분"]
#: The types of a subject.
SUBJECT_TYPES = {
    "수학(상)": ["다항식", "방정식과 부등식", "도형의 방정식"],
    "수학(하)": ["집합과 명제", "함수와 그래프", "경우의 수"],
    "공통수학1": ["다항식", "방정식과 부등식", "경우의 수", "행렬"],
    "공통수학2": ["도형의 방정식", "집합과 명제", "함수와 그래프"],
    "수학I": _POWERS, "대수": _POWERS, "수학II": _CALCULUS_1, "미적분I": _CALCULUS_1, "미적분": _CALCULUS_2, "미적분II": _CALCULUS_2,
    "확률과통계": ["경우의 수", "확률", "통계"],
    "기하": ["이차곡선", "평면벡터", "공간도형과 공간좌표"],
}

#: Other names of types, without spaces.
ALIASES = {
    "미분": "다항함수의 미분", "적분": "다항함수의 적분", "미분법": "여러 가지 함수의 미분", "적분법": "여러 가지 함수의 적분", "도함수의활용": "다항함수의 미분", "정적분의활용": "다항함수의 적분",
    "함수": "함수와 그래프", "순열과조합": "경우의 수", "순열": "경우의 수", "조합": "경우의 수", "통계적추정": "통계", "확률분포": "통계", "벡터": "평면벡터", "공간도형": "공간도형과 공간좌표",
    "공간좌표": "공간도형과 공간좌표", "지수": "지수와 로그", "로그": "지수와 로그", "지수함수": "지수함수와 로그함수", "로그함수": "지수함수와 로그함수", "극한": "함수의 극한과 연속",
    "방정식": "방정식과 부등식", "부등식": "방정식과 부등식", "도형": "도형의 방정식", "집합": "집합과 명제", "명제": "집합과 명제", "여러가지미분법": "여러 가지 함수의 미분",
    "여러가지적분법": "여러 가지 함수의 적분", "연속": "함수의 극한과 연속", "함수의연속": "함수의 극한과 연속", "함수의극한": "함수의 극한과 연속",
}
#: Words for no type.
NO_TYPE = ("미분류", "기타", "없음", "모름", "null", "none", "unknown", "n/a")

_TO_CALCULUS_2 = {
    "다항함수의 미분": "여러 가지 함수의 미분", "다항함수의 적분": "여러 가지 함수의 적분", "함수의 극한과 연속": "여러 가지 함수의 미분", "삼각함수": "여러 가지 함수의 미분",
    "지수함수와 로그함수": "여러 가지 함수의 미분", "지수와 로그": "여러 가지 함수의 미분", "수열": "수열의 극한",
}
_TO_CALCULUS_1 = {"여러 가지 함수의 미분": "다항함수의 미분", "여러 가지 함수의 적분": "다항함수의 적분"}
#: What a guessed type becomes in a subject that lacks it.
REMAPS = {"미적분": _TO_CALCULUS_2, "미적분II": _TO_CALCULUS_2, "수학II": _TO_CALCULUS_1, "미적분I": _TO_CALCULUS_1}
#: Types whose score moves on where a transcendental function is seen, and the one that says a subject has none.
MOVES = [("다항함수의 미분", "여러 가지 함수의 미분"), ("다항함수의 적분", "여러 가지 함수의 적분")]
POLYNOMIAL = "다항함수의 미분"
#: Signals over text with its spaces ("raw") or without ("flat").
SIGNALS = {
    "trans": [("flat", r"(?i)sin|cos|tan|log|e\^|지수함수|삼각함수"), ("raw", "(^|[^프블])로그"), ("raw", r"(?i)(^|[^a-z])ln(?=[\s(x]|$)")],
    "diff": [("raw", "미분|도함수|접선|극[대소]|극[댓솟]값"), ("flat", r"[a-z]'\(")],
    "integ": [("raw", "적분|∫")],
}
#: Fixed value: sets named in a phrase that says nothing of a type.
SET_PHRASE = "(실수|자연수|정수|유리수|양의 ?실수|음이 ?아닌 ?정수) ?전체의 ?집합"
