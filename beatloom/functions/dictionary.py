"""Terms of one language and what narrations of the other call them."""

# Fixed values, in the order in which partial matches are tried.
CROSS_LANGUAGE = {
    "discover": ["探索", "发现", "发散"], "define": ["深化", "定义", "聚焦"], "deliver": ["打磨", "交付", "执行"],
    "ai": ["人工智能", "AI"], "llm": ["大语言模型", "大模型"], "gpt": ["GPT"], "agent": ["代理", "智能体"], "prompt": ["提示词", "提示"], "token": ["词元", "token"],
    "next-token": ["下一个词", "下一个词元", "逐词预测"], "next token": ["下一个词", "下一个词元", "逐词预测"],
    "design": ["设计"], "designer": ["设计师"], "world-class": ["世界级", "一流"], "world class": ["世界级", "一流"], "gradient": ["渐变"], "purple gradient": ["紫色渐变"],
    "ui": ["界面", "UI"], "ux": ["体验", "UX"], "prototype": ["原型", "草图"], "wireframe": ["线框", "线框图"],
    "critic": ["批评家", "批评", "评审"], "critic agent": ["批评家代理", "批评代理"], "executor": ["执行者", "执行"], "executor agent": ["执行者代理", "执行代理"],
    "iteration": ["迭代", "反复"], "workflow": ["流程", "工作流"], "process": ["流程", "过程"],
    "quality": ["质量", "品质"], "boring": ["平庸", "无聊", "普通"], "amazing": ["惊艳", "出色", " amazing"], "mediocre": ["平庸", "普通"], "generic": ["通用", "千篇一律", "普通"],
    "safe": ["安全", "保守"], "safest": ["最安全", "最保守"], "creative": ["创意", "创造性"], "diverse": ["多样", "多样化"], "variety": ["多样", "变化"],
    "potential": ["潜力", "潜能"], "99%": ["99%", "百分之九十九"], "1%": ["1%", "百分之一"], "video": ["视频"], "animation": ["动画", "动效"], "motion": ["动效", "动态"],
    "subtract": ["减法", "做减法", "减去"], "simplify": ["简化", "精简"], "clutter": ["凌乱", "杂乱", "拥挤"], "clean": ["简洁", "干净", "清爽"], "minimal": ["极简", "简约"],
    "white space": ["留白", "空白"], "archive": ["存档", "归档"], "sketch": ["草图", "草稿"], "exploration": ["探索", "发散"], "bold": ["大胆", "醒目"], "random": ["随机", "随意"], "seed": ["种子", "随机种子"],
}
