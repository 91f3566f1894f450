"""Reading PDF bytes into rows of pages, text blocks, images, graphics and links, one document at a time."""
