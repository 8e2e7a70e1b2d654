"""The resolution presets as rows."""

# Model, tier, aspect, width, height, reliability, and whether it is the recommended size of its model.
PRESETS = [
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "1:1", 1024, 1024, "verified", True),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "4:3", 1152, 896, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "3:4", 896, 1152, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "3:2", 1216, 832, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "2:3", 832, 1216, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "16:9", 1344, 768, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "9:16", 768, 1344, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "21:9", 1536, 640, "verified", False),
    ("FLUX.2 Klein 4B", "1 MP (sweet spot)", "9:21", 640, 1536, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "1:1", 1408, 1408, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "4:3", 1632, 1216, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "3:4", 1216, 1632, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "3:2", 1728, 1152, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "2:3", 1152, 1728, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "16:9", 1888, 1056, "verified", False),
    ("FLUX.2 Klein 4B", "2 MP", "9:16", 1056, 1888, "verified", False),
    ("FLUX.2 Klein 4B", "3 MP", "1:1", 1728, 1728, "community", False),
    ("FLUX.2 Klein 4B", "3 MP", "4:3", 2000, 1504, "community", False),
    ("FLUX.2 Klein 4B", "3 MP", "3:4", 1504, 2000, "community", False),
    ("FLUX.2 Klein 4B", "3 MP", "3:2", 2128, 1424, "community", False),
    ("FLUX.2 Klein 4B", "3 MP", "2:3", 1424, 2128, "community", False),
    ("FLUX.2 Klein 4B", "3 MP", "16:9", 2320, 1296, "community", False),
    ("FLUX.2 Klein 4B", "3 MP", "9:16", 1296, 2320, "community", False),
    ("FLUX.2 Klein 4B", "4 MP", "1:1", 2016, 2016, "risk", False),
    ("FLUX.2 Klein 4B", "4 MP", "4:3", 2304, 1728, "risk", False),
    ("FLUX.2 Klein 4B", "4 MP", "3:4", 1728, 2304, "risk", False),
    ("FLUX.2 Klein 4B", "4 MP", "16:9", 2688, 1504, "risk", False),
    ("FLUX.2 Klein 4B", "4 MP", "9:16", 1504, 2688, "risk", False),
    ("FLUX.2 Klein 9B", "1 MP", "1:1", 1024, 1024, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "4:3", 1152, 896, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "3:4", 896, 1152, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "3:2", 1216, 832, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "2:3", 832, 1216, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "16:9", 1344, 768, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "9:16", 768, 1344, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "21:9", 1536, 640, "verified", False),
    ("FLUX.2 Klein 9B", "1 MP", "9:21", 640, 1536, "verified", False),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "1:1", 1408, 1408, "verified", True),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "4:3", 1632, 1216, "verified", False),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "3:4", 1216, 1632, "verified", False),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "3:2", 1728, 1152, "verified", False),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "2:3", 1152, 1728, "verified", False),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "16:9", 1888, 1056, "verified", False),
    ("FLUX.2 Klein 9B", "2 MP (sweet spot)", "9:16", 1056, 1888, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "1:1", 1728, 1728, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "4:3", 2000, 1504, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "3:4", 1504, 2000, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "3:2", 2128, 1424, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "2:3", 1424, 2128, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "16:9", 2320, 1296, "verified", False),
    ("FLUX.2 Klein 9B", "3 MP", "9:16", 1296, 2320, "verified", False),
    ("FLUX.2 Klein 9B", "4 MP", "1:1", 2016, 2016, "risk", False),
    ("FLUX.2 Klein 9B", "4 MP", "4:3", 2304, 1728, "risk", False),
    ("FLUX.2 Klein 9B", "4 MP", "3:4", 1728, 2304, "risk", False),
    ("FLUX.2 Klein 9B", "4 MP", "16:9", 2688, 1504, "risk", False),
    ("FLUX.2 Klein 9B", "4 MP", "9:16", 1504, 2688, "risk", False),
    ("FLUX.2 Dev", "1 MP", "1:1", 1024, 1024, "verified", False),
    ("FLUX.2 Dev", "1 MP", "4:3", 1152, 896, "verified", False),
    ("FLUX.2 Dev", "1 MP", "3:4", 896, 1152, "verified", False),
    ("FLUX.2 Dev", "1 MP", "3:2", 1216, 832, "verified", False),
    ("FLUX.2 Dev", "1 MP", "2:3", 832, 1216, "verified", False),
    ("FLUX.2 Dev", "1 MP", "16:9", 1344, 768, "verified", False),
    ("FLUX.2 Dev", "1 MP", "9:16", 768, 1344, "verified", False),
    ("FLUX.2 Dev", "1 MP", "21:9", 1536, 640, "verified", False),
    ("FLUX.2 Dev", "1 MP", "9:21", 640, 1536, "verified", False),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "1:1", 1408, 1408, "verified", True),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "4:3", 1632, 1216, "verified", False),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "3:4", 1216, 1632, "verified", False),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "3:2", 1728, 1152, "verified", False),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "2:3", 1152, 1728, "verified", False),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "16:9", 1888, 1056, "verified", False),
    ("FLUX.2 Dev", "2 MP (sweet spot)", "9:16", 1056, 1888, "verified", False),
    ("FLUX.2 Dev", "3 MP", "1:1", 1728, 1728, "verified", False),
    ("FLUX.2 Dev", "3 MP", "4:3", 2000, 1504, "verified", False),
    ("FLUX.2 Dev", "3 MP", "3:4", 1504, 2000, "verified", False),
    ("FLUX.2 Dev", "3 MP", "3:2", 2128, 1424, "verified", False),
    ("FLUX.2 Dev", "3 MP", "2:3", 1424, 2128, "verified", False),
    ("FLUX.2 Dev", "3 MP", "16:9", 2320, 1296, "verified", False),
    ("FLUX.2 Dev", "3 MP", "9:16", 1296, 2320, "verified", False),
    ("FLUX.2 Dev", "4 MP", "1:1", 2016, 2016, "verified", False),
    ("FLUX.2 Dev", "4 MP", "4:3", 2304, 1728, "verified", False),
    ("FLUX.2 Dev", "4 MP", "3:4", 1728, 2304, "verified", False),
    ("FLUX.2 Dev", "4 MP", "16:9", 2688, 1504, "verified", False),
    ("FLUX.2 Dev", "4 MP", "9:16", 1504, 2688, "verified", False),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "1:1", 1328, 1328, "verified", True),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "4:3", 1472, 1140, "verified", False),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "3:4", 1140, 1472, "verified", False),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "3:2", 1584, 1056, "verified", False),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "2:3", 1056, 1584, "verified", False),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "16:9", 1664, 928, "verified", False),
    ("Qwen-Image", "Native (1.5-1.8 MP)", "9:16", 928, 1664, "verified", False),
    ("Qwen-Image", "1 MP (preview)", "1:1", 1024, 1024, "community", False),
    ("Qwen-Image", "1 MP (preview)", "4:3", 1152, 896, "community", False),
    ("Qwen-Image", "1 MP (preview)", "3:4", 896, 1152, "community", False),
    ("Qwen-Image", "1 MP (preview)", "3:2", 1248, 832, "community", False),
    ("Qwen-Image", "1 MP (preview)", "2:3", 832, 1248, "community", False),
    ("Qwen-Image", "1 MP (preview)", "16:9", 1344, 768, "community", False),
    ("Qwen-Image", "1 MP (preview)", "9:16", 768, 1344, "community", False),
    ("Qwen-Image", "2 MP", "1:1", 1408, 1408, "community", False),
    ("Qwen-Image", "2 MP", "4:3", 1632, 1216, "community", False),
    ("Qwen-Image", "2 MP", "3:4", 1216, 1632, "community", False),
    ("Qwen-Image", "2 MP", "3:2", 1728, 1152, "community", False),
    ("Qwen-Image", "2 MP", "2:3", 1152, 1728, "community", False),
    ("Qwen-Image", "2 MP", "16:9", 1888, 1056, "community", False),
    ("Qwen-Image", "2 MP", "9:16", 1056, 1888, "community", False),
    ("Qwen-Image", "3 MP", "1:1", 1728, 1728, "community", False),
    ("Qwen-Image", "3 MP", "4:3", 2016, 1504, "community", False),
    ("Qwen-Image", "3 MP", "3:4", 1504, 2016, "community", False),
    ("Qwen-Image", "3 MP", "16:9", 2304, 1280, "community", False),
    ("Qwen-Image", "3 MP", "9:16", 1280, 2304, "community", False),
    ("Qwen-Image", "4 MP", "1:1", 2048, 2048, "community", False),
    ("Qwen-Image", "4 MP", "4:3", 2304, 1728, "community", False),
    ("Qwen-Image", "4 MP", "3:4", 1728, 2304, "community", False),
    ("Qwen-Image", "4 MP", "16:9", 2688, 1504, "community", False),
    ("Qwen-Image", "4 MP", "9:16", 1504, 2688, "community", False),
    ("Qwen-Image", "HD", "1:1", 1920, 1920, "community", False),
    ("Qwen-Image", "HD", "1:1", 2560, 2560, "community", False),
    ("Qwen-Image", "HD", "4:3", 2560, 1920, "community", False),
    ("Qwen-Image", "HD", "3:4", 1920, 2560, "community", False),
    ("Qwen-Image", "HD", "16:9", 2560, 1440, "community", False),
    ("Qwen-Image", "HD", "9:16", 1440, 2560, "community", False),
    ("Z-Image", "Tier 1024", "1:1", 1024, 1024, "verified", True),
    ("Z-Image", "Tier 1024", "4:3", 1152, 864, "verified", False),
    ("Z-Image", "Tier 1024", "3:4", 864, 1152, "verified", False),
    ("Z-Image", "Tier 1024", "9:7", 1152, 896, "verified", False),
    ("Z-Image", "Tier 1024", "7:9", 896, 1152, "verified", False),
    ("Z-Image", "Tier 1024", "3:2", 1248, 832, "verified", False),
    ("Z-Image", "Tier 1024", "2:3", 832, 1248, "verified", False),
    ("Z-Image", "Tier 1024", "16:9", 1280, 720, "verified", False),
    ("Z-Image", "Tier 1024", "9:16", 720, 1280, "verified", False),
    ("Z-Image", "Tier 1024", "21:9", 1344, 576, "verified", False),
    ("Z-Image", "Tier 1024", "9:21", 576, 1344, "verified", False),
    ("Z-Image", "Tier 1280", "1:1", 1280, 1280, "verified", True),
    ("Z-Image", "Tier 1280", "4:3", 1472, 1104, "verified", False),
    ("Z-Image", "Tier 1280", "3:4", 1104, 1472, "verified", False),
    ("Z-Image", "Tier 1280", "9:7", 1440, 1120, "verified", False),
    ("Z-Image", "Tier 1280", "7:9", 1120, 1440, "verified", False),
    ("Z-Image", "Tier 1280", "3:2", 1536, 1024, "verified", False),
    ("Z-Image", "Tier 1280", "2:3", 1024, 1536, "verified", False),
    ("Z-Image", "Tier 1280", "16:9", 1600, 896, "verified", False),
    ("Z-Image", "Tier 1280", "9:16", 896, 1600, "verified", False),
    ("Z-Image", "Tier 1280", "21:9", 1680, 720, "verified", False),
    ("Z-Image", "Tier 1280", "9:21", 720, 1680, "verified", False),
    ("Z-Image", "Tier 1536", "1:1", 1536, 1536, "community", False),
    ("Z-Image", "Tier 1536", "4:3", 1728, 1296, "community", False),
    ("Z-Image", "Tier 1536", "3:4", 1296, 1728, "community", False),
    ("Z-Image", "Tier 1536", "9:7", 1728, 1344, "community", False),
    ("Z-Image", "Tier 1536", "7:9", 1344, 1728, "community", False),
    ("Z-Image", "Tier 1536", "3:2", 1872, 1248, "community", False),
    ("Z-Image", "Tier 1536", "2:3", 1248, 1872, "community", False),
    ("Z-Image", "Tier 1536", "16:9", 2048, 1152, "community", False),
    ("Z-Image", "Tier 1536", "9:16", 1152, 2048, "community", False),
    ("Z-Image", "Tier 2K", "1:1", 2048, 2048, "extrapolation", False),
    ("Z-Image", "Tier 2K", "4:3", 2048, 1536, "extrapolation", False),
    ("Z-Image", "Tier 2K", "3:4", 1536, 2048, "extrapolation", False),
    ("Z-Image", "Tier 2K", "16:9", 2048, 1152, "extrapolation", False),
    ("Z-Image", "Tier 2K", "9:16", 1152, 2048, "extrapolation", False),
]
