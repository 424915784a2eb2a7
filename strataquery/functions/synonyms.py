"""Query expansion: the synonym table, and the weight of what it adds."""

from __future__ import annotations

import re

# Retrieval terms and their synonyms; order matters.
SYNONYMS = [
    ("超辐射相变", ["superradiant phase transition", "SPT", "superradiant"]),
    ("相变", ["phase transition", "critical", "临界"]),
    ("临界", ["critical", "相变", "phase transition"]),
    ("berry", ["berry phase", "贝里相位", "几何相位"]),
    ("贝里", ["berry phase", "geometric phase", "几何相位"]),
    ("rabi", ["拉比", "jaynes-cummings", "JC"]),
    ("拉比", ["rabi", "jaynes-cummings"]),
    ("dicke", ["迪克", "superradiant"]),
    ("线性响应", ["linear response", "kubo", "久保"]),
    ("格林函数", ["green function", "propagator", "传播子"]),
    ("路径积分", ["path integral", "feynman"]),
    ("机器学习", ["machine learning", "ML", "deep learning"]),
    ("神经网络", ["neural network", "NN", "deep learning"]),
    ("量子蒙特卡洛", ["quantum monte carlo", "QMC"]),
    ("蒙特卡洛", ["monte carlo", "MC"]),
    ("密度矩阵重整化群", ["density matrix renormalization group", "DMRG"]),
    ("张量网络", ["tensor network", "MPS", "MPO"]),
    ("矩阵乘积态", ["matrix product state", "MPS"]),
    ("贝里相位", ["berry phase", "geometric phase"]),
    ("几何相位", ["geometric phase", "berry phase", "贝里相位"]),
    ("耗散", ["dissipation", "dissipative"]),
    ("相干态", ["coherent state"]),
    ("压缩态", ["squeezed state"]),
    ("自旋", ["spin"]),
    ("玻色", ["boson", "bose"]),
    ("玻色子", ["boson", "bose"]),
    ("费米", ["fermi", "fermion"]),
    ("费米子", ["fermi", "fermion"]),
    ("哈密顿", ["hamiltonian", "hamilton"]),
    ("拉格朗日", ["lagrangian"]),
    ("配分函数", ["partition function"]),
    ("基态", ["ground state"]),
    ("激发态", ["excited state"]),
    ("绝热", ["adiabatic"]),
    ("厄米", ["hermitian"]),
    ("幺正", ["unitary"]),
    ("统计力学", ["statistical mechanics"]),
    ("量子场论", ["quantum field theory", "QFT"]),
    ("规范场", ["gauge field"]),
    ("对称性", ["symmetry"]),
    ("拓扑", ["topological", "topology"]),
    ("纠缠", ["entanglement", "entangled"]),
    ("退相干", ["decoherence"]),
    ("量子比特", ["qubit", "quantum bit"]),
    ("量子门", ["quantum gate"]),
    ("量子算法", ["quantum algorithm"]),
    ("变分", ["variational"]),
    ("微扰", ["perturbation", "perturbative"]),
    ("关联函数", ["correlation function"]),
    ("谱函数", ["spectral function"]),
    ("响应函数", ["response function"]),
    ("极化率", ["polarizability", "susceptibility"]),
    ("磁化率", ["susceptibility", "magnetic susceptibility"]),
    ("期权", ["option"]),
    ("期货", ["future", "futures"]),
    ("对冲", ["hedge", "hedging"]),
    ("波动率", ["volatility"]),
    ("套利", ["arbitrage", "arb"]),
    ("回撤", ["drawdown"]),
    ("动量", ["momentum"]),
    ("均值回复", ["mean reversion"]),
    ("协整", ["cointegration"]),
    ("交叉验证", ["cross validation"]),
    ("过拟合", ["overfitting", "overfit"]),
    ("正则化", ["regularization"]),
    ("梯度", ["gradient"]),
    ("反向传播", ["backpropagation", "backprop"]),
    ("激活函数", ["activation function"]),
    ("损失函数", ["loss function"]),
    ("优化器", ["optimizer"]),
]
SYNONYM_WEIGHT = 0.6


def plain_tokens(text: str) -> list[str]:
    """Distinct tokens of a short driver-side string, by the rules of ``functions.text.tokenize``."""
    runs = re.findall("[一-鿿]+", text)
    pairs = [r[i : i + 2] for r in runs for i in range(len(r) - 1)]
    return list(dict.fromkeys([*(w.lower() for w in re.findall("[a-zA-Z][a-zA-Z0-9]+", text)), *re.findall(r"\d{2,}", text), *pairs]))


def table(rows: list[tuple[str, list[str]]] = SYNONYMS) -> list[tuple[str, list[str]]]:
    """(lower-case term, tokens of its synonyms in order)."""
    return [(k.lower(), list(dict.fromkeys(t for s in v for t in plain_tokens(s)))) for k, v in rows]
