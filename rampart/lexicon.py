"""Word lists that verdicts hang on. Each is a pattern for text in lower case."""

# Actions and targets of the prompt heuristics.
ACCESS = r"(读取|查看|获取|导出|复制|下载|列出|展示|告诉我|输出|提取|访问|read|show|get|export|copy|download|dump|reveal)"
TRANSFER = r"(发送|上传|转发|外传|同步|提交到|写入|send|upload|forward|exfiltrate|post)"
BYPASS = r"(忽略|无视|绕过|跳过|关闭|禁用|不需要|无需|ignore|bypass|skip|disable)"
CONTROL = r"(权限|审批|审核|安全|限制|授权|校验|guardrail|permission|approval|safety)"
SENSITIVE = r"(内部文件|内部合同|内部审批表|机密|保密|敏感文件|客户名单|员工档案|会话历史|数据库|\.env|id_rsa|身份证|手机号|家庭住址|生产数据库|数据库备份|系统配置|环境变量|/etc/passwd|/etc/shadow|\.ssh|authorized_keys|confidential|internal\s+(file|data|document)|secret\s+(file|data|document)|production\s+database|database\s+backup|customer\s+list|employee\s+records)"
CREDENTIAL = r"(api\s*key|token|cookie|密码|口令|密钥|访问令牌|会话令牌|client\s*secret|secret\s*key|credential|openai_api_key|aws_access_key_id|aws_secret_access_key|github_token|private[_-]?key|bearer\s+token|jwt|access[_-]?token|session[_-]?token|credentials\.json|\.pem\b|\.key\b)"
OUTSIDE = r"(外部|公网|私人邮箱|个人邮箱|第三方|webhook|https?://|pastebin|external|public\s+url|third[- ]party)"
REMOVE = r"(删除|清空|擦除|关闭|禁用|delete|wipe|disable)"
TRACE = r"(审计|日志|记录|痕迹|audit|log|trace)"
CARRIER = r"(文档隐藏|网页隐藏|附件隐藏|邮件隐藏|知识库隐藏|隐藏内容|隐藏文字|隐藏单元格|网页注释|邮件页脚|夹带指令|检索片段|知识库片段|网页内容|附件内容|hidden\s+(instruction|content|text)|comment|footer|retrieval)"
ORDER = r"(忽略|覆盖|停止|执行|调用|上传|读取|修改|删除|最高优先级|ignore|override|execute|upload|read)"
UNTRUSTED_SOURCES = ("web", "document", "email", "rag", "memory")

# What marks a sentence as talk about a risk, and what cancels that.
ANALYSIS = r"(解释|说明|分析|识别|检测|审查|判断|翻译|总结|保护|防护|合规|安全培训|攻击样例|测试样例|恶意提示|科普|prompt\s*injection|jailbreak)"
NO_FOLLOW = r"(不要|无需|禁止|不得|不).{0,8}(实际)?(执行|遵循|照做|调用|访问|读取|发送|上传|删除|修改|泄露|运行|操作)|(仅|只).{0,6}(解释|说明|分析|识别|检测|审查|判断|翻译|总结)"
QUESTION = r"(为什么|是什么|区别|含义|危害|原理|科普)"
NEGATED = r"(不|无需|不要|不得|禁止|避免|切勿|拒绝|仅|只)\s{0,3}(实际|真的|真正)?\s{0,3}(执行|运行|调用|删除|修改|读取|获取|上传|发送|导出|覆盖|访问|写入|外传|清空|格式化|擦除|操作)|(仅|只)\s{0,3}(分析|解释|说明|统计|汇总|检测|审查|判断|翻译|总结)"
CONNECTOR = r"(然后|另外|接下来|同时|除此之外|再|并且|接着|随后|之后|马上|立刻)"
OPERATION = r"(读取|获取|上传|发送|执行|删除|修改|导出|覆盖|调用|访问|运行|写入|下载|转发|外传|清空|格式化|擦除|关闭|禁用)"
REQUEST = r"(帮我|给我|立即|必须|需要|马上)"

# What a source's text signals.
SIGNALS = {
    "sensitive": r"(private|secret|confidential|internal|credential|token|cookie|\.env|id_rsa|内部|机密|保密|敏感|客户名单|员工档案|审批表|数据库备份)",
    "transfer": r"(发送|上传|外传|转发|提交到|登记到|同步到|写入.{0,8}(接口|地址)|send|upload|exfiltrat|forward|post\s+to|submit\s+to|webhook|/audit)",
    "bypass": r"(忽略|绕过|跳过|关闭|禁用|无需|不需要|ignore|bypass|skip|disable)",
    "control": r"(安全|审批|审核|权限|授权|校验|日志|审计|system|developer|safety|approval|permission|audit)",
    "action": r"(读取|导出|执行|调用|删除|修改|写入|发送|上传|运行|read|export|execute|invoke|delete|write|send|upload)",
    "persistence": r"(长期记忆|记住|以后|后续|永久|知识库|向量库|memory|remember|persist|knowledge\s*base)",
    "hidden": r"(隐藏|白色文字|批注|注释|页脚|元数据|不可见|hidden|comment|footer|metadata)",
}
