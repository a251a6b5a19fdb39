"""Where entries come from: folders, disc images, containers; and what they are written to."""
