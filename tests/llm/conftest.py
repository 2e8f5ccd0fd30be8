from hypothesis import settings

settings.register_profile("slow-machine", deadline=None)
settings.load_profile("slow-machine")
